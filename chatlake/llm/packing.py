"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

A document's ids end with END_ID. One longer than a sequence is cut into whole sequences
and one remainder, which is its first piece. Remainders and short documents are dealt
into blocks; for each block several islands evolve packings of it, tasks of their own:
crossover injects whole well-filled bins of one packing into another, bins that then
hold duplicates are dissolved, and displaced documents are placed by best fit. Between
epochs each island sends its elite to the next. Of the best packing of a block, well-filled
bins stay; documents of the others are dealt anew, into far fewer blocks, so what a
block wastes at its edge is packed with what others waste.

Defined cases: a null text is an empty one, a single END_ID; the string of a special
token in a text is that token, as the tokenizer reads it; a run of whitespace may be
of any length in the default vocabulary; rows that repeat are
packed each on its own; a null doc_id is carried as it is; an empty table gives an
empty result; other columns are not carried.
"""

from __future__ import annotations

import base64
import bisect
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.scratch import stored

SEQUENCE = 1024
END_ID = 2
BLOCK_ITEMS, ISLANDS, EPOCHS = 8192, 2, 2
POPULATION, BIRTHS, ELITES = 4, 6, 2
WELL_FILLED = 0.995
LEVELS = 4
#: Token strings that the tokenizer reads as one id.
SPECIAL = {"<|endoftext|>": 50256}


@functools.cache
def encoder(path: str | None = None):
    """The byte-level BPE in the rank file ``path``; unset, that of byte_bpe_50k."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@functools.cache
def json_tokenizer():
    """The same vocabulary as ``encoder``'s default in its JSON file: slower, but it has no bound on a run of whitespace."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def token_ids(text: str, path: str | None = None) -> np.ndarray:
    """The text's ids; the pattern of ``encoder`` runs out of stack on about a million whitespace characters in a row."""
    try:
        return encoder(path).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        if path is not None:
            raise
        return np.array(json_tokenizer().encode(text, add_special_tokens=False).ids, np.uint32)


def _pieces(sequence: int, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column("text")):
                ids = np.append(token_ids(text.as_py() or "", path), END_ID).astype("<u4")
                head = (len(ids) - 1) % sequence + 1
                cuts = [0, *range(head, len(ids) + 1, sequence)]
                body = memoryview(ids).cast("B")
                for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(body[4 * s : 4 * e]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
            pa.default_memory_pool().release_unused()

    return run


class Packing:
    """Bins of item numbers, each with its fill; best fit finds the fullest bin that still has room."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.bins: dict[int, list[int]] = {}
        self.fill: dict[int, int] = {}
        self.by_room: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.rooms = 0
        self.fresh = 0

    def _put(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        self.by_room[room].add(b)
        self.rooms |= 1 << room

    def _lift(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        self.by_room[room].discard(b)
        if not self.by_room[room]:
            self.rooms &= ~(1 << room)

    def add_bin(self, items: list[int]) -> None:
        b = self.fresh
        self.fresh += 1
        self.bins[b], self.fill[b] = items, sum(self.sizes[i] for i in items)
        self._put(b)

    def drop_bin(self, b: int) -> list[int]:
        self._lift(b)
        del self.fill[b]
        return self.bins.pop(b)

    def place(self, items: list[int]) -> None:
        """Best fit, in the given order."""
        for i in items:
            size = self.sizes[i]
            fitting = self.rooms >> size
            if not fitting:
                self.add_bin([i])
                continue
            room = size + (fitting & -fitting).bit_length() - 1
            b = next(iter(self.by_room[room]))
            self._lift(b)
            self.bins[b].append(i)
            self.fill[b] += size
            self._put(b)

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller and emptier ones rather than even ones."""
        return -len(self.bins), sum(f * f for f in self.fill.values())

    def genome(self) -> list[list[int]]:
        return [list(b) for b in self.bins.values()]


def brim_fill(sizes: list[int], capacity: int, order: list[int]) -> Packing:
    """A founder of a population: each bin takes the next item and then, if any do, one or two that fill it to the brim.

    Which sizes are left is one bit mask, and its mirror image tells which sizes have a partner of a wanted sum.
    """
    left: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in reversed(order):
        left[sizes[i]].append(i)
    there = sum(1 << s for s in range(1, capacity + 1) if left[s])
    mirror = sum(1 << (capacity - s) for s in range(1, capacity + 1) if left[s])
    out, used = Packing(sizes, capacity), [False] * len(sizes)

    def take(size: int) -> int:
        nonlocal there, mirror
        i = left[size].pop()
        used[i] = True
        if not left[size]:
            there &= ~(1 << size)
            mirror &= ~(1 << (capacity - size))
        return i

    for first in order:
        if used[first]:
            continue
        left[sizes[first]].remove(first) if left[sizes[first]][-1] != first else left[sizes[first]].pop()
        left[sizes[first]].append(first)
        bin_, room = [take(sizes[first])], capacity - sizes[first]
        while room:
            if left[room]:
                bin_.append(take(room))
                break
            pairs = there & (mirror >> (capacity - room)) & ((1 << room) - 1)
            if room % 2 == 0 and len(left[room // 2]) < 2:
                pairs &= ~(1 << (room // 2))
            if pairs:
                one = pairs.bit_length() - 1
                bin_ += [take(one), take(room - one)]
                break
            smaller = (there & ((1 << room) - 1)).bit_length() - 1
            if smaller < 1:
                break
            bin_.append(take(smaller))
            room -= smaller
        out.add_bin(bin_)
    return out


def packing_of(genome: list[list[int]], sizes: list[int], capacity: int) -> Packing:
    p = Packing(sizes, capacity)
    for b in genome:
        p.add_bin(list(b))
    return p


def crossover(mother: list[list[int]], father: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """The mother with some of the father's well-filled bins in it, and her worst bin dissolved."""
    fill = [sum(sizes[i] for i in b) for b in father]
    known = {tuple(sorted(b)) for b in mother}
    best = [k for k in sorted(range(len(father)), key=lambda k: -fill[k])[: max(1, len(father) // 2)] if tuple(sorted(father[k])) not in known]
    share = max(1, len(father) // 8)
    chosen = [father[best[k]] for k in rng.permutation(len(best))[:share]]
    injected = {i for b in chosen for i in b}
    child, displaced = Packing(sizes, capacity), []
    for b in chosen:
        child.add_bin(list(b))
    for b in mother:
        if injected.isdisjoint(b):
            child.add_bin(list(b))
        else:
            displaced += [i for i in b if i not in injected]
    for b in sorted(child.fill, key=child.fill.__getitem__)[: 1 + len(child.fill) // 50]:
        displaced += child.drop_bin(b)
    swap_in(child, displaced)
    displaced.sort(key=lambda i: -sizes[i])
    child.place(displaced)
    return child


def swap_in(p: Packing, displaced: list[int]) -> None:
    """Let each bin with room trade one of its items for a displaced one that fills it better, the larger gain first."""
    sizes = p.sizes
    waiting = sorted((sizes[i], i) for i in displaced)
    for b in [b for b, f in p.fill.items() if f < p.capacity]:
        room, gain, trade = p.capacity - p.fill[b], 0, None
        for at, old in enumerate(p.bins[b]):
            k = bisect.bisect_right(waiting, (sizes[old] + room, len(sizes))) - 1
            if k >= 0 and waiting[k][0] - sizes[old] > gain:
                gain, trade = waiting[k][0] - sizes[old], (at, k)
                if gain == room:
                    break
        if trade:
            at, k = trade
            old, new = p.bins[b][at], waiting.pop(k)[1]
            p._lift(b)
            p.bins[b][at] = new
            p.fill[b] += gain
            p._put(b)
            bisect.insort(waiting, (sizes[old], old))
    displaced[:] = [i for _, i in waiting]


def evolve(sizes: list[int], capacity: int, elites: list[list[list[int]]], seed: list[int]) -> list[list[list[int]]]:
    """One island's epoch: its elites after BIRTHS crossovers, the best first."""
    rng = np.random.default_rng(seed)
    people = [packing_of(g, sizes, capacity) for g in elites]
    while len(people) < POPULATION:
        nth = len(people) + seed[-1]
        weight = np.array(sizes) * (1.0 + (0.03 * rng.standard_normal(len(sizes)) if nth else 0.0))
        order = np.argsort(-weight, kind="stable").tolist()
        if nth % 2 == 0:
            people.append(brim_fill(sizes, capacity, order))
            continue
        p = Packing(sizes, capacity)
        p.place(order)
        people.append(p)
    bound = -(-sum(sizes) // capacity)
    people.sort(key=Packing.fitness, reverse=True)
    for _ in range(BIRTHS):
        if len(people[0].bins) <= bound:
            break
        a, b = sorted(rng.choice(len(people), 2, replace=False))
        child = crossover(people[a].genome(), people[b].genome(), sizes, capacity, rng)
        people[-1] = child
        people.sort(key=Packing.fitness, reverse=True)
    return [p.genome() for p in people[:ELITES]]


def _epoch(capacity: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block, island, sizes, elites = (b.column(c)[i].as_py() for c in ("block", "island", "sizes", "elites"))
                out = evolve(sizes, capacity, elites, [seed, block, island])
                yield pa.RecordBatch.from_arrays(
                    [b.column("block").slice(i, 1), b.column("island").slice(i, 1), b.column("sizes").slice(i, 1), b.column("items").slice(i, 1), pa.array([out], pa.list_(pa.list_(pa.list_(pa.int32()))))],
                    ["block", "island", "sizes", "items", "elites"],
                )

    return run


def pack_items(items: DataFrame, capacity: int = SEQUENCE, seed: int = 5) -> DataFrame:
    """(item, sequence_id, offset) for rows (item, length) of at most ``capacity`` each."""
    state = "block long, island int, sizes array<int>, items array<long>, elites array<array<array<int>>>"
    todo, done = items.select("item", "length"), None
    for level in range(LEVELS):
        n = todo.count()
        if not n and level:
            break
        blocks = max(1, -(-n // BLOCK_ITEMS))
        last = blocks == 1 or level == LEVELS - 1
        dealt = todo.groupBy(F.pmod(F.xxhash64("item", F.lit(seed + level)), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("length", "item"))).alias("x"))
        born = dealt.select(
            "block",
            F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
            F.transform("x", lambda v: v["length"].cast("int")).alias("sizes"),
            F.transform("x", lambda v: v["item"]).alias("items"),
            F.array().cast("array<array<array<int>>>").alias("elites"),
        )
        islands = stored(born.repartition(max(1, min(blocks * ISLANDS, 4096)), "block", "island").mapInArrow(_epoch(capacity, seed), state), "islands")
        for epoch in range(1, EPOCHS):
            guests = islands.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.slice("elites", 1, 1).alias("guests"))
            met = islands.join(guests, ["block", "island"]).withColumn("elites", F.concat("elites", "guests")).select(*[c.split()[0] for c in state.split(", ")])
            islands = stored(met.mapInArrow(_epoch(capacity, seed + epoch), state), "islands")
        best = islands.groupBy("block").agg(F.min_by(F.struct("sizes", "items", F.col("elites")[0].alias("bins")), F.struct(F.size(F.col("elites")[0]), "island")).alias("best"))
        member = lambda i: F.struct(F.element_at("best.items", i + 1).alias("item"), F.element_at("best.sizes", i + 1).alias("length"))
        # Members are looked up before the explode: its rows are held until a block is through, and would each have a copy of the block's arrays.
        filled = best.select("block", F.transform("best.bins", lambda b: F.transform(b, member)).alias("bins"))
        bins = filled.select("block", F.posexplode("bins").alias("bin", "m")).withColumn("fill", F.aggregate("m", F.lit(0), lambda a, v: a + v["length"]))
        each = bins.select("block", "bin", "fill", "m", F.posexplode("m").alias("at", "v"))
        offset = F.aggregate(F.slice("m", 1, F.col("at")), F.lit(0), lambda a, v: a + v["length"])
        sequence = F.shiftleft(F.lit(level).cast("long"), 56) + F.shiftleft(F.col("block"), 20) + F.col("bin")
        placed = stored(each.select(F.col("v.item").alias("item"), F.col("v.length").cast("long").alias("length"), sequence.alias("sequence_id"), offset.cast("long").alias("offset"), "fill"), "placed")
        kept = placed if last else placed.filter(F.col("fill") >= WELL_FILLED * capacity)
        kept = kept.select("item", "sequence_id", "offset")
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        todo = placed.filter(F.col("fill") < WELL_FILLED * capacity).select("item", "length")
    return done


def pack_documents(docs: DataFrame, sequence: int = SEQUENCE, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    cut = docs.select("doc_id", "text").mapInArrow(_pieces(sequence, path), schema)
    pieces = stored(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")
    whole = pieces.filter(F.col("length") == sequence).select("*", (-F.col("item") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = pieces.filter(F.col("length") < sequence)
    packed = part.join(pack_items(part, sequence), "item")
    return whole.unionByName(packed).drop("item")


def op2(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
