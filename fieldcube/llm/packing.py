"""Best-fit packing of token sequences by a configuration linear program over the length histogram."""

from __future__ import annotations

import re
import struct

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import SLICE, Memo, documents, materialize

CAPACITY = 2048
#: A single space between other characters always begins a new pre-token.
BREAK = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, those of ``Tokenizer.encode(text, add_special_tokens=False)``.

    A text that holds an added token of the tokenizer's goes to it as a whole.
    Others are cut at spaces that stand alone, where a byte-level tokenizer always
    begins a new pre-token; the ids of " " and what follows are remembered.  Those
    parts are merged by tiktoken with the ranks of the same vocabulary, which gives
    the same ids (a test compares them) in half the time.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        # What stands for a byte in the vocabulary: bytes that print stand for themselves, the others follow from 256.
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {b: b for b in own} | {256 + k: b for k, b in enumerate(b for b in range(256) if b not in own)}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(byte[ord(c)] for c in token): k for token, k in vocabulary.items() if token not in added}
        self.ids = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known = Memo(self._after_space, limit)

    def _bytes(self, text: str) -> bytes:
        ids = self.ids(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _after_space(self, part: str) -> bytes | None:
        """None if a space before the part would not stand alone."""
        return None if not part or part[0].isspace() or part[-1].isspace() else self._bytes(" " + part)

    def encode(self, text: str) -> bytes:
        if self.added and self.added.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        first, *rest = text.split(" ")
        if not (first and first[-1].isspace()):
            try:
                return self._bytes(first) + b"".join(map(self.known.__getitem__, rest))
            except TypeError:
                pass
        first, *rest = BREAK.split(text)
        if not rest:
            return self._bytes(first)
        return self._bytes(first) + b"".join(map(self.known.__getitem__, rest[:-1])) + self._bytes(" " + rest[-1])


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(id, row, piece, start, length, ids): each document's ids and a closing 0, cut into pieces.

    A document of at most ``capacity`` ids is one piece.  Of a longer one, all
    pieces are full but the first, which has what is left over.  A null text is
    empty (one id).  row: a hash of the text, which tells rows with equal ids apart.
    ids: little-endian unsigned 32-bit numbers, one after the other.
    """
    path = path or tokenizer_path()
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([src.schema["id"], src.schema["row"], *[T.StructField(c, T.LongType()) for c in ("piece", "start", "length")], T.StructField("ids", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        encoder = Encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                which, rows = [], []
                for k, ids in enumerate(map(encoder.encode, (t or "" for t in part.column(2).to_pylist()))):
                    ids += b"\0\0\0\0"
                    n = len(ids) // 4
                    first = n % capacity or min(n, capacity)
                    cuts = [0, *range(first, n + 1, capacity)]
                    for piece in range(len(cuts) - 1):
                        a, b = cuts[piece], cuts[piece + 1]
                        which.append(k)
                        rows.append((piece, a, b - a, ids[4 * a : 4 * b]))
                cols = [part.column(j).take(pa.array(which, pa.int64())) for j in range(2)]
                cols += [pa.array([r[j] for r in rows], pa.int64() if j < 3 else pa.binary()) for j in range(4)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(run, schema)


def fills(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(best, pick) by room: the largest sum of values of lengths (with repeats) that fit, and the last length taken (-1: none)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    ends = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(int(lengths[0]), capacity + 1):
        n = ends[room]
        got = value[:n] + best[room - lengths[:n]]
        k = int(got.argmax())
        if got[k] > best[room - 1]:
            best[room], pick[room] = got[k], k
        else:
            best[room] = best[room - 1]
    return best, pick


def filling(pick: np.ndarray, lengths: np.ndarray, room: int) -> list[int]:
    """The lengths (indexes, with repeats) of the best filling of ``room``."""
    out = []
    while room > 0:
        if pick[room] < 0:
            room -= 1
            continue
        out.append(int(pick[room]))
        room -= int(lengths[pick[room]])
    return out


def cover(lengths: np.ndarray, need: np.ndarray, capacity: int, value: np.ndarray, slack: float = 0.01) -> tuple[dict[tuple, float], float]:
    """({configuration: times}, bound): a fractional covering of the whole ``need``, nothing left and nothing twice.

    Weights start at ``value`` and shrink as their lengths are covered.  A knapsack
    prices the configurations; of each length, largest first, the best one with it is
    used if it is worth the best of all but ``slack``, until one of its lengths is
    covered.  bound: so many sequences any covering needs, by the duals of the pricings.
    """
    left, weight, bound = need.astype(float), value.astype(float), 0.0
    plan: dict[tuple, float] = {}
    while True:
        live = np.flatnonzero(left > 0)
        if not len(live):
            return plan, bound
        price = weight[live] * lengths[live] / capacity
        best, pick = fills(price, lengths[live], capacity)
        bound = max(bound, float(need[live] @ price / best[capacity]))
        used = False
        for j in range(len(live) - 1, -1, -1):
            room = capacity - int(lengths[live[j]])
            worth = best[capacity] * (1 - (slack if used else 1e-12))
            # The last one is used in any case if none was.
            if left[live[j]] <= 0 or (price[j] + best[room] < worth and (used or j)):
                continue
            k, a = np.unique(live[[j, *filling(pick, lengths[live], room)]], return_counts=True)
            if (left[k] <= 0).any():
                continue
            times = float((left[k] / a).min())
            config = tuple(zip(k.tolist(), a.tolist(), strict=True))
            plan[config] = plan.get(config, 0.0) + times
            left[k] -= a * times
            left[k[left[k] <= 1e-9]] = 0
            weight[k] *= np.exp(-a * times / need[k])
            used = True


def solve(lengths: np.ndarray, need: np.ndarray, capacity: int, gap: float = 0.01, rounds: int = 6) -> tuple[dict[tuple, float], float]:
    """The shortest covering of some rounds, and the largest bound; the first round within ``gap`` of the bound is the last.

    Between rounds lengths that stand in badly filled configurations gain value, by
    the sequences that they took.
    """
    value, bound, best = np.ones(len(lengths)), 0.0, None
    for _ in range(rounds):
        plan, least = cover(lengths, need, capacity, value)
        bound = max(bound, least)
        if best is None or sum(plan.values()) < sum(best.values()):
            best = plan
        if sum(best.values()) <= (1 + gap) * bound:
            break
        value = np.zeros(len(lengths))
        for config, times in plan.items():
            k, a = np.array(config).T
            value[k] += a * times / need[k] * capacity / (a @ lengths[k])
    return best, bound


def configurations(demand: dict[int, int], capacity: int = CAPACITY, gap: float = 0.01, report: dict | None = None) -> list[tuple[dict[int, int], int]]:
    """(configuration, times): how often each set of lengths fills a sequence, so that the demand is met exactly.

    The linear program (fewest sequences that cover the demand) is solved by
    multiplicative weights until every length is covered, to ``gap`` of a dual bound.
    The solution is rounded down; then its largest fractions are rounded up where the
    demand still allows it.  What is left is packed largest first, each sequence
    filled as well as a subset-sum of the lengths left allows.  Work depends on the
    number of different lengths, not on the demand.

    ``report`` gets, in tokens of all: lp (placed by the program rounded down), up
    (by its fractions), greedy (the rest); and value and bound of the program.
    """
    lengths = np.array(sorted(x for x, n in demand.items() if n > 0))
    if not len(lengths):
        return []
    left = np.array([demand[int(x)] for x in lengths], np.int64)
    tokens = [int(left @ lengths)]
    out: list[tuple[dict[int, int], int]] = []

    def use(config: tuple, times: int) -> None:
        if times > 0:
            k, a = np.array(config).T
            out.append(({int(lengths[i]): int(n) for i, n in config}, times))
            left[k] -= a * times

    plan, bound = solve(lengths, left.copy(), capacity, gap)
    for config, x in sorted(plan.items(), key=lambda c: -c[1]):
        k, a = np.array(config).T
        use(config, int(min(np.floor(x + 1e-9), (left[k] // a).min())))
    tokens.append(int(left @ lengths))
    for config, x in sorted(plan.items(), key=lambda c: -((c[1] + 1e-9) % 1)):
        k, a = np.array(config).T
        use(config, int((left[k] >= a).all() and (x + 1e-9) % 1 > 1e-6))
    tokens.append(int(left @ lengths))
    if report is not None:
        shares = [(tokens[0] - tokens[1]) / tokens[0], (tokens[1] - tokens[2]) / tokens[0], tokens[2] / tokens[0]]
        report |= dict(zip(("lp", "up", "greedy"), shares, strict=True)) | {"value": sum(plan.values()), "bound": bound}
    out += _fill_rest(lengths, left, capacity)
    return out


def _fill_rest(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Largest first: each time the largest length left and the subset of the others that fills best, as often as it lasts."""
    out = []
    left = left.copy()
    while left.any():
        big = int(np.flatnonzero(left)[-1])
        config = {big: 1}
        for k in _subset(lengths, np.where(np.arange(len(left)) == big, left - 1, left), capacity - int(lengths[big])):
            config[k] = config.get(k, 0) + 1
        times = min(int(left[k]) // a for k, a in config.items())
        for k, a in config.items():
            left[k] -= a * times
        out.append(({int(lengths[k]): a for k, a in config.items()}, times))
    return out


def _subset(lengths: np.ndarray, left: np.ndarray, room: int) -> list[int]:
    """Indexes of lengths, none more often than it is left, of the largest sum within ``room``; larger lengths are tried first.

    Reachable sums are the bits of one integer; each length adds itself up to as
    often as it is left, in doubling groups.
    """
    reach, trail, limit = 1, [], (1 << (room + 1)) - 1
    for k in np.flatnonzero((left > 0) & (lengths <= room))[::-1]:
        size, n, group = int(lengths[k]), min(int(left[k]), room // int(lengths[k])), 1
        while n > 0:
            g = min(group, n)
            before = reach
            reach |= (reach << (size * g)) & limit
            if reach != before:
                trail.append((int(k), g, size * g, before))
            n -= g
            group *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for k, g, add, before in reversed(trail):
        if not before >> at & 1:
            out += [k] * g
            at -= add
    return out


def layout(demand: dict[int, int], capacity: int = CAPACITY, **options) -> tuple[dict[int, tuple], int]:
    """For each length sorted runs of its ranks (first rank, copies a sequence, first sequence, offset); and the number of sequences."""
    runs: dict[int, list] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for config, times in configurations(demand, capacity, **options):
        offset = 0
        for size, a in config.items():
            runs.setdefault(size, []).append((rank.get(size, 0), a, sequence, offset))
            rank[size] = rank.get(size, 0) + a * times
            offset += size * a
        sequence += times
    return {size: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for size, r in runs.items()}, sequence


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, rows_per_bucket: int = 20_000, **options) -> DataFrame:
    """``pieces`` with ids_crc32, sequence_id and offset: as few sequences of at most ``capacity`` tokens as it can.

    Only the histogram of lengths (at most ``capacity`` entries) reaches the
    driver.  Pieces of a length are ranked by counts in hash ranges, so that one
    length may hold most rows, and the rank tells sequence and offset.  Ranks are
    found without the ids, which join their place last and not at all if the
    caller drops them.
    """
    ids = pieces(df, id_col, text_col, capacity, path).withColumn("ids_crc32", F.crc32("ids")).withColumn("at", F.monotonically_increasing_id())
    whole = materialize(ids, "pieces")
    rows = whole.select("at", "id", "row", "piece", "length")
    demand = {int(r.length): int(r.n) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan, _ = layout(demand, capacity, **options)
    buckets = max(64, -(-max(demand.values(), default=0) // rows_per_bucket))
    bucket = F.pmod(F.xxhash64("id", "row", "piece"), F.lit(buckets)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("id", "row", "piece", "at")
    rows = rows.withColumn("rn", F.row_number().over(own) - 1).join(counts, ["length", "bucket"])
    rows = rows.withColumn("rank", (F.col("before") + F.col("rn")).cast("long")).drop("before", "rn", "bucket")
    shared = df.sparkSession.sparkContext.broadcast(plan)
    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        import pyarrow as pa

        plan = shared.value
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for one in np.unique(size):
                at = np.flatnonzero(size == one)
                first, copies, seq, off = plan[int(one)]
                k = np.searchsorted(first, rank[at], "right") - 1
                turn = rank[at] - first[k]
                sequence[at] = seq[k] + turn // copies[k]
                offset[at] = off[k] + turn % copies[k] * one
            yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(sequence), pa.array(offset)], names=schema.names)

    placed = rows.select("at", "length", "rank").mapInArrow(place, schema)
    return whole.join(placed, "at").select("id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): whole sequences, the pieces of ``pack`` put together by their offsets."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    whole = F.aggregate(parts, F.lit(b""), lambda s, x: F.concat(s, x))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """Checksums of the ids that ``pack`` gives."""
    return pack(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
