"""Packing token pieces into sequences by a grouping genetic algorithm on islands.

Documents become token ids with an end id, and only those longer than a sequence are cut into pieces. Pieces are dealt
at random into shards of about SHARD pieces. For each shard, several islands evolve their own populations of packings;
a packing's genes are whole bins. Crossover injects well-filled whole bins of one parent into the other, removes the
bins that hold duplicates of their pieces, and puts the displaced pieces back by best fit; mutation dissolves poorly
filled bins and puts their pieces back. After each epoch every island gets the elite of its neighbour. A shard is done
as soon as a packing needs no more bins than its words' sum demands, which most reach with their first, best-fit
packing. Sequences filled to FULL stay as they are; the pieces of all others go to a next level with fewer shards, until
one shard holds the rest, so that dealing into shards costs next to nothing.

Each island's state is one row; Spark spreads islands over tasks, and every level and epoch is a written table.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.llm.common import column_name, table, written
from vellumine.llm.tokens import encoder

#: Tokens of a sequence, pieces of a shard, islands of a shard, epochs, generations of an epoch, packings of a population.
LENGTH, SHARD, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4096, 2000, 3, 3, 25, 6

#: Sequences filled to this share are final at once; the most levels.
FULL, LEVELS = 0.995, 6

Bins = list[list[int]]

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """The pieces of every document (doc_id, text): doc_id, piece, start, length, ids (little-endian unsigned 32-bit).

    A null text is empty and gives one piece of the end id alone.
    """
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder(tokenizer, False).encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for k, start in enumerate(range(0, len(ids), 4 * length)):
                        one = ids[start : start + 4 * length]
                        rows.append((doc_id, k, start // 4, len(one) // 4, one))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECES)


def best_fit(bins: Bins, items: list[int], lengths: np.ndarray, cap: int) -> Bins:
    """bins with the items put in, each into the fullest bin with room for it, else into a new one."""
    free = sorted((cap - int(sum(lengths[i] for i in b)), k) for k, b in enumerate(bins))
    for i in items:
        need = int(lengths[i])
        at = bisect_left(free, (need, -1))
        if at < len(free):
            room, k = free.pop(at)
            bins[k].append(i)
        else:
            room, k = cap, len(bins)
            bins.append([i])
        insort(free, (room - need, k))
    return bins


def rank(bins: Bins, lengths: np.ndarray, cap: int) -> tuple[int, float]:
    """Fewer bins first, then more unevenly filled ones (a nearly empty bin is nearly gone)."""
    return len(bins), -float(sum((sum(lengths[i] for i in b) / cap) ** 2 for b in bins))


def crossover(a: Bins, b: Bins, lengths: np.ndarray, cap: int, rng: np.random.Generator) -> Bins:
    """Some well-filled bins of b, the bins of a that share no piece with them, and the rest put back by best fit."""
    by_fill = sorted(b, key=lambda x: -sum(lengths[i] for i in x))
    many = int(rng.integers(1, max(2, len(b) // 2 + 1)))
    injected = [list(x) for x in by_fill[:many]]
    held = {i for x in injected for i in x}
    kept = [list(x) for x in a if held.isdisjoint(x)]
    displaced = [i for x in a if not held.isdisjoint(x) for i in x if i not in held]
    return best_fit(injected + kept, sorted(displaced, key=lambda i: -lengths[i]), lengths, cap)


def mutate(a: Bins, lengths: np.ndarray, cap: int, rng: np.random.Generator) -> Bins:
    """a with some of its least filled bins and a few others dissolved and put back by best fit."""
    by_fill = sorted(a, key=lambda x: sum(lengths[i] for i in x))
    worst = 1 + int(rng.integers(0, 4))
    others = set(rng.integers(0, len(a), size=3).tolist())
    gone = [x for k, x in enumerate(by_fill) if k < worst or k in others]
    kept = [list(x) for k, x in enumerate(by_fill) if k >= worst and k not in others]
    noise = {i: lengths[i] * (1 + 0.1 * rng.random()) for x in gone for i in x}
    return best_fit(kept, sorted(noise, key=noise.__getitem__, reverse=True), lengths, cap)


def least_bins(lengths: np.ndarray, cap: int) -> int:
    return max(int(len(lengths) > 0), -(-int(lengths.sum()) // cap), int((2 * lengths > cap).sum()))


def seeded(lengths: np.ndarray, cap: int, rng: np.random.Generator, first: bool, many: int = POPULATION) -> list[Bins]:
    """A population: best fit by descending length, and by that order disturbed."""
    out = []
    for k in range(many):
        noise = lengths * (1 + (0.0 if first and k == 0 else 0.3) * rng.random(len(lengths)))
        out.append(best_fit([], np.argsort(-noise, kind="stable").tolist(), lengths, cap))
        if len(out[-1]) <= least_bins(lengths, cap):
            break
    return out


def evolve(population: list[Bins], lengths: np.ndarray, cap: int, rng: np.random.Generator, generations: int = GENERATIONS) -> list[Bins]:
    """The population after some generations, best first; it stops at a packing that cannot be better."""
    least = least_bins(lengths, cap)
    ranked = sorted(((rank(p, lengths, cap), p) for p in population), key=lambda x: x[0])
    for _ in range(generations):
        if len(ranked[0][1]) <= least:
            break
        a, b = (ranked[int(min(rng.integers(0, len(ranked), 2)))][1] for _ in range(2))
        child = crossover(a, b, lengths, cap, rng) if a is not b else mutate(a, lengths, cap, rng)
        if rng.random() < 0.5:
            child = mutate(child, lengths, cap, rng)
        ranked = sorted([*ranked, (rank(child, lengths, cap), child)], key=lambda x: x[0])[: max(POPULATION, 1)]
    return [p for _, p in ranked]


def _to_genes(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _from_genes(genes) -> Bins:
    out: Bins = [[] for _ in range(max(genes, default=-1) + 1)]
    for i, k in enumerate(genes):
        out[k].append(i)
    return out


STATE = "shard long, island int, lengths array<int>, population array<array<int>>, best array<int>, bins int, least int"


def _state(shard: int, island: int, lengths: np.ndarray, population: list[Bins], cap: int) -> tuple:
    genes = [_to_genes(p, len(lengths)) for p in population]
    return shard, island, lengths.tolist(), genes, genes[0], len(population[0]), least_bins(lengths, cap)


def _columns(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["shard", "island", "lengths", "population", "best", "bins", "least"])


def _evolved(shards: DataFrame, cap: int, islands: int, epochs: int, level: int) -> DataFrame:
    """shard, best (bin of each of its pieces) for shards (shard, lengths): the best of all islands."""

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for shard, island, lengths in zip(pdf["shard"], pdf["island"], pdf["lengths"], strict=True):
                lengths, rng = np.asarray(lengths, np.int64), np.random.default_rng([level, int(shard), int(island)])
                population = seeded(lengths, cap, rng, island == 0)
                rows.append(_state(shard, island, lengths, sorted(population, key=lambda p: rank(p, lengths, cap)), cap))
            yield _columns(rows)

    def epoch(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for r in pdf.itertuples(index=False):
                    lengths, rng = np.asarray(r.lengths, np.int64), np.random.default_rng([level, int(r.shard), int(r.island), number])
                    population = [_from_genes(list(g)) for g in r.population]
                    if r.migrant is not None:
                        population.append(_from_genes(list(r.migrant)))
                    rows.append(_state(r.shard, r.island, lengths, evolve(population, lengths, cap, rng), cap))
                yield _columns(rows)

        return run

    # A set number of partitions: Spark must not coalesce rows that are few and small, but each seconds of work.
    tasks = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda df: df.repartition(tasks, "shard", "island")
    first = spread(shards.select("shard", F.lit(0).alias("island"), "lengths")).mapInPandas(start, STATE)
    state = written(first, "pack-islands")
    done, open_ = state.filter("bins <= least"), state.filter("bins > least")
    more = open_.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(max(1, islands - 1))))).select("shard", F.col("_i").alias("island"), "lengths")
    finished, any_open = [done], bool(open_.limit(1).count())
    if any_open and islands > 1:
        open_ = written(open_.unionByName(spread(more).mapInPandas(start, STATE)), "pack-islands")
    for number in range(epochs if any_open else 0):
        ring = Window.partitionBy("shard").orderBy("island")
        whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        migrant = F.coalesce(F.lag("best").over(ring), F.last("best").over(whole))
        moved = open_.withColumn("migrant", migrant).withColumn("found", F.min("bins").over(whole))
        state = written(spread(moved.filter("found > least").drop("found")).mapInPandas(epoch(number), STATE), "pack-islands")
        finished.append(moved.filter("found <= least").select(*state.columns))
        open_ = state
        if not open_.limit(1).count():
            break
    if any_open:
        finished.append(open_)
    all_ = finished[0]
    for f in finished[1:]:
        all_ = all_.unionByName(f)
    return all_.groupBy("shard").agg(F.min_by("best", F.struct("bins", "island")).alias("best"))


def pack(rows: DataFrame, length: str = "length", cap: int = LENGTH, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """rows (a written table) with sequence_id and offset: no sequence holds more than cap, and offsets have no gaps.

    Rows are dealt by a number of their own, so equal rows are no hot group. A row longer than cap has a sequence of
    its own; rows of length 0 or null (as 0) fit anywhere. An empty table gives an empty result. Columns of rows named
    sequence_id or offset are replaced.
    """
    kept = [c for c in rows.columns if c.lower() not in ("sequence_id", "offset")]
    number = column_name(rows, "pack_row")
    left = written(rows.select(*kept, F.monotonically_increasing_id().alias(number)), "pack-rows")
    out, total = None, left.count()
    for level in range(LEVELS):
        n = max(1, -(-total // shard))
        size = F.least(F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)), F.lit(cap)).cast("int")
        dealt = left.select(F.pmod(F.xxhash64(number, F.lit(level)), F.lit(n)).alias("_shard"), F.struct(size.alias("size"), F.col(number).alias("number"), F.struct(*kept).alias("row")).alias("item"))
        shards = dealt.groupBy(F.col("_shard").alias("shard")).agg(F.collect_list("item").alias("items"))
        shards = written(shards.select("shard", F.sort_array("items", asc=False).alias("items")), "pack-shards")
        best = _evolved(shards.select("shard", F.col("items.size").alias("lengths")), cap, islands, epochs, level)

        @F.pandas_udf("array<struct<bin: int, at: long, fill: long>>")
        def placed(sizes: pd.Series, bins: pd.Series) -> pd.Series:
            rows = []
            for s, b in zip(sizes, bins, strict=True):
                s, b = np.asarray(s, np.int64), np.asarray(b, np.int64)
                order = np.argsort(b, kind="stable")
                ends = np.cumsum(s[order])
                fill = np.bincount(b, s, minlength=1).astype(np.int64)
                at = np.empty(len(s), np.int64)
                at[order] = ends - s[order] - (np.cumsum(fill) - fill)[b[order]]
                rows.append([{"bin": int(x), "at": int(y), "fill": int(fill[x])} for x, y in zip(b, at, strict=True)])
            return pd.Series(rows)

        joined = shards.join(best, "shard").select("shard", F.explode(F.arrays_zip("items", placed(F.col("items.size"), F.col("best")).alias("place"))).alias("x"))
        # A shard has as many sequences as pieces at most.
        sequence = F.shiftleft(F.lit(level).cast("long"), 58) + F.shiftleft(F.col("shard"), 32) + F.col("x.place.bin")
        all_ = written(joined.select("x.items.row.*", F.col("x.items.number").alias(number), sequence.alias("sequence_id"), F.col("x.place.at").alias("offset"), F.col("x.place.fill").alias("_fill")), "pack-level")
        last = n == 1 or level == LEVELS - 1
        final = all_ if last else all_.filter(F.col("_fill") >= FULL * cap)
        final = final.select(*kept, "sequence_id", "offset")
        out = final if out is None else out.unionByName(final)
        if last:
            break
        left = all_.filter(F.col("_fill") < FULL * cap).select(*kept, number)
        total = left.count()
        if not total:
            break
    return out


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cut = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)
    rows = written(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pack-pieces")
    return pack(rows).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op9_pack_sequences": op9_pack_sequences}
ORACLES: dict[str, str] = {}
