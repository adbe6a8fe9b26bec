"""MinHash near-deduplication with tensored banding.

A document is the set of its distinct word shingles; documents are linked when their sets' Jaccard
similarity reaches PERCENT / 100 (compared in integers).

* Sketches. Two small collections of TABLES minhash tuples (A and B, WIDTH minhashes each) are made
  per set. The keys of the TABLES * TABLES tables combine a tuple of A with one of B, so the tables
  take 2 * TABLES * WIDTH minhashes in place of TABLES**2 * 2 * WIDTH. Two sets of similarity s share
  a key with probability (1 - (1 - s**WIDTH)**TABLES)**2, 0.9985 at s = 0.8.
* Classes. Equal sets are one class, so a group of copies is one node however large it is.
* Candidates. Buckets are read in order of (key, id) from range partitions, so a bucket of any size
  is cut over tasks and passes by as a stream. Beside the id, a row has the set's size and two bits
  of each minhash; pairs whose sizes allow the similarity and whose bits agree in LIKELY places (at
  s = 0.8 all but 3 in 100,000) are candidates. Buckets of up to SMALL sets try all their pairs. In
  larger ones every set is tried against leaders, which are sets that are unlike all earlier
  leaders, and sets that resemble their leader only moderately also with their predecessor; so pairs
  grow with the bucket and not with its square. Leaders of buckets that a partition's edge cuts are
  brought together once more.
* Parities. Every set has a bitmap in which each shingle flips one bit. The bits in which two bitmaps
  differ are at most the shingles in which the sets differ, so too many of them prove that a pair is
  no link. Bitmaps have two to four bits a shingle; the larger of two is folded to the smaller. Only
  pairs that the bitmaps allow are held against each other on the full sets.
* Orphans. A set of a large bucket that resembles a partner, is not linked with it and is in the smaller
  component may have links that were not tried. Its bitmap is compared with those of all sets of its
  large buckets that are in other components, and every pair that the bitmaps allow is confirmed. Buckets
  are dealt in squares of PART asking by PART other sets, so a task holds two such parts at a time.
* Links. Candidates are confirmed on the full sets (of 64-bit shingle hashes: two shingles that differ
  count as one with probability 2**-64). Components of the links are found by large-star and
  small-star steps.

Defined results: null and empty texts and texts without words have an empty set and are linked with
nothing; with fewer words than the shingle length the whole sequence is one shingle. Rows that
share an id are one node. A row without id takes the component of its class and never stays. An
empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

SHINGLE, PERCENT = 5, 80
TABLES, WIDTH, SEED = 10, 3, 11
HASHES = 2 * TABLES * WIDTH
#: Sets of a bucket whose pairs are all tried; places of HASHES that agree in a likely pair, and in a
#: pair that needs no second partner; rows that a task holds.
SMALL, LIKELY, SURE, HELD = 8, 40, 54, 100_000
#: Sets of a bucket, about, that a task compares at once with as many orphans.
PART = 768
#: What a set does in a square: it asks, it is one of the others, or both.
ASKS, OTHER, BOTH = 1, 2, 3
#: Bits of the smallest and the largest bitmap.
FEWEST_BITS, MOST_BITS = 256, 1 << 16

_RNG = np.random.default_rng(SEED)
MULTIPLY = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(29))


def word_table() -> common.WordTable:
    """Words to 64-bit hashes."""
    return common.WordTable(lambda words: (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), np.ones(len(words), np.int64)), limit=100_000, dtype=np.uint64)


def shingles(table: common.WordTable, text: bytes, k: int) -> np.ndarray:
    """The text's distinct shingles as sorted 64-bit hashes."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = table.gather(table.rows(words))
    n = min(k, len(words))
    own = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        own = own * _ODD + h[j : len(h) - n + 1 + j]
    return np.unique(_mix(own + np.uint64(n)))


def parities(flat: np.ndarray, size: np.ndarray) -> list[bytes]:
    """A bitmap per set, of two to four bits for each of its shingles; ``flat`` has the sets' hashes one after the other."""
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64), FEWEST_BITS, MOST_BITS)
    first = np.cumsum(bits) - bits
    place = (flat & np.repeat((bits - 1).astype(np.uint64), size)).astype(np.int64) + np.repeat(first, size)
    packed = np.packbits(np.bincount(place, minlength=int(bits.sum())).astype(np.uint8) & 1, bitorder="little").tobytes()
    cuts = [0, *np.cumsum(bits // 8).tolist()]
    return [packed[i:j] for i, j in zip(cuts, cuts[1:])]


def folded(bitmaps: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64-bit words folded to ``width`` words; parities stay parities."""
    while bitmaps.shape[1] > width:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] ^ bitmaps[:, half:]
    return bitmaps


def by_width(bitmaps: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Width in words to the numbers of the bitmaps that have it, and these as rows."""
    width = np.array([len(b) // 8 for b in bitmaps], np.int64)
    some = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
    return {w: (k, np.frombuffer(b"".join([bitmaps[i] for i in k.tolist()]), np.uint64).reshape(len(k), w)) for w, k in some.items()}


def may_link(differ: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of ``total`` shingles together that differ in ``differ`` at least can reach the similarity."""
    return differ * (100 + percent) <= total * (100 - percent)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_hash, a, b, s1, s2, bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table()
        for batch in common.blocks(batches):
            sets = [shingles(table, t, k) for t in common.raw_texts(batch)]
            size = np.array([len(s) for s in sets])
            mins = np.zeros((len(sets), HASHES), np.uint64)
            full = np.flatnonzero(size)
            if len(full):
                flat, first = np.concatenate(sets), (np.cumsum(size) - size)[full]
                for j in range(HASHES):
                    mins[full, j] = np.minimum.reduceat(flat * MULTIPLY[j] + ADD[j], first)
            keys = mins.reshape(len(sets), 2 * TABLES, WIDTH)
            key = keys[:, :, 0].copy()
            for j in range(1, WIDTH):
                key = _mix(key) * _ODD + keys[:, :, j]
            key = key.view(np.int64)
            two = (_mix(mins) & np.uint64(3)) << (np.uint64(2) * (np.arange(HASHES, dtype=np.uint64) % np.uint64(30)))
            two = np.bitwise_or.reduce(two.reshape(len(sets), 2, 30), axis=2).view(np.int64)
            yield common.arrow_batch(
                {
                    "doc_id": batch.column(0),
                    "n_shingles": size,
                    "set_hash": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                    "a": list(key[:, :TABLES]),
                    "b": list(key[:, TABLES:]),
                    "s1": two[:, 0],
                    "s2": two[:, 1],
                    "bits": parities(np.concatenate([*sets, np.zeros(0, np.uint64)]), size),
                },
                {"doc_id": pa.int64(), "n_shingles": pa.int64(), "set_hash": pa.binary(), "a": pa.list_(pa.int64()), "b": pa.list_(pa.int64()), "s1": pa.int64(), "s2": pa.int64(), "bits": pa.binary()},
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return common.map_arrow(rows, run, "doc_id long, n_shingles long, set_hash binary, a array<long>, b array<long>, s1 long, s2 long, bits binary")


def table_keys(classes: DataFrame) -> DataFrame:
    """(key, node, n, s1, s2): the tensored keys of every class."""
    carried = ["node", F.col("n_shingles").cast("int").alias("n"), "s1", "s2"]
    one = classes.select(*carried, "b", F.posexplode("a").alias("i", "x"))
    both = one.select("node", "n", "s1", "s2", "i", "x", F.posexplode("b").alias("j", "y"))
    return both.select(F.xxhash64("i", "j", "x", "y").alias("key"), "node", "n", "s1", "s2")


_FIELDS = np.uint64(0x5555555555555555)


def agreement(rows: np.ndarray, i, j) -> np.ndarray:
    """Minhashes whose two bits agree, for pairs of rows; rows is (key, node, n, s1, s2)."""
    out = np.full(np.broadcast(i, j).shape, HASHES, np.int64)
    for c in (3, 4):
        x = (rows[c][i] ^ rows[c][j]).view(np.uint64)
        out -= np.bitwise_count((x | (x >> np.uint64(1))) & _FIELDS).astype(np.int64)
    return out


def fit_sizes(rows: np.ndarray, i, j, percent: int) -> np.ndarray:
    a, b = rows[2][i], rows[2][j]
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def led(rows: np.ndarray, percent: int, leaders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (2, n) among one bucket's rows and its leaders so far, and the leaders then."""
    pairs, left = [], rows
    known = leaders
    while True:  # against the leaders in blocks, then the first row that is unlike all becomes one
        alike = np.zeros(left.shape[1], bool)
        for k in range(known.shape[1]):
            both = np.concatenate([left, known[:, k : k + 1]], axis=1)
            i = np.arange(left.shape[1])
            j = np.full(left.shape[1], left.shape[1])
            near = agreement(both, i, j)
            hit = (near >= LIKELY) & fit_sizes(both, i, j, percent)
            some = np.flatnonzero(hit & (left[1] != known[1, k]))
            pairs.append(np.stack([np.full(len(some), known[1, k]), left[1, some]]))
            weak = some[near[some] < SURE]
            if len(weak) > 1:  # also with the one before it
                last, this = weak[:-1], weak[1:]
                good = (agreement(left, last, this) >= LIKELY) & fit_sizes(left, last, this, percent)
                pairs.append(np.stack([left[1, last[good]], left[1, this[good]]]))
            alike |= hit
        left = left[:, ~alike]
        if not left.shape[1]:
            break
        known = left[:, :1]
        leaders = np.concatenate([leaders, known], axis=1)
    return np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1), leaders


def bucket_pairs(rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Candidates (2, n) of whole small and large buckets, whose rows are sorted by (key, node); and the large buckets."""
    key = rows[0]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff([*first, len(key)])
    small = np.repeat(size <= SMALL, size)
    pairs = []
    for d in range(1, SMALL):
        i = np.flatnonzero((key[:-d] == key[d:]) & small[:-d]) if d < len(key) else np.zeros(0, np.int64)
        i = i[fit_sizes(rows, i, i + d, percent)]
        i = i[agreement(rows, i, i + d) >= LIKELY]
        pairs.append(np.stack([rows[1, i], rows[1, i + d]]))
    none = np.zeros((5, 0), np.int64)
    large = [rows[:, first[k] : first[k] + size[k]] for k in np.flatnonzero(size > SMALL)]
    joined = lambda x: np.unique(np.concatenate([np.zeros((2, 0), np.int64), *x], axis=1), axis=1)
    return joined(pairs), joined([led(x, percent, none)[0] for x in large]), large


def candidates(keys: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(u, v, led), u < v: likely pairs that share a bucket, and whether it was a large one; (key, nodes) of the large ones, in parts."""
    schema = "u long, v long, key long, n long, s1 long, s2 long, nodes array<long>"
    types = {c: pa.int64() for c in ("u", "v", "key", "n", "s1", "s2")} | {"nodes": pa.list_(pa.int64())}

    def pass_by(edges: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none = np.zeros((5, 0), np.int64)
            held, waiting, open_key, leaders = none, [], None, none

            def out(pairs, cut=none, led_=True, large=()):
                """Pairs, leaders that go on, and the nodes of large buckets: three kinds of rows."""
                p, c, x = pairs.shape[1], cut.shape[1], len(large) if edges else 0
                null = lambda k: pa.nulls(k, pa.int64())
                ints = lambda *parts: pa.concat_arrays([pa.array(y, pa.int64()) if not isinstance(y, pa.Array) else y for y in parts])
                columns = [ints(pairs.min(0) if p else null(0), cut[1], null(x)), ints(pairs.max(0) if p else null(0), null(c + x))]
                columns += [ints(null(p), cut[0], [int(y[0, 0]) for y in large[:x]]), ints(np.full(p, int(led_)), cut[2], null(x))]
                columns += [ints(null(p), cut[k], null(x)) for k in (3, 4)]
                columns += [pa.concat_arrays([pa.nulls(p + c, types["nodes"]), pa.array([y[1] for y in large[:x]], types["nodes"])])]
                return common.arrow_batch(dict(zip(types, columns)), types)

            def close(rows, whole: bool):
                """The open bucket gets its rows; at its end its leaders go on if an edge may cut it."""
                nonlocal leaders, open_key
                pairs, leaders = led(rows, percent, leaders)
                cut = leaders if whole and edges else none
                if whole:
                    leaders, open_key = none, None
                return out(np.unique(pairs, axis=1), cut, large=(rows,) if rows.shape[1] else ())

            def passed(rows):
                small, pairs, large = bucket_pairs(rows, percent)
                yield out(small, led_=False)
                yield out(pairs, large=tuple(large))

            begun = False
            for batch in batches:
                waiting.append(np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in range(5)]))
                if sum(x.shape[1] for x in waiting) < HELD:
                    continue
                held, waiting = np.concatenate([held, *waiting], axis=1), []
                if not begun and held.shape[1]:
                    begun, open_key = True, held[0, 0]  # the first bucket may have begun in another partition
                if open_key is not None:
                    own = held[0] == open_key
                    done = not own.all()
                    yield close(held[:, own], done)
                    held = held[:, ~own]
                if held.shape[1]:
                    last = held[0] == held[0, -1]
                    if not last.all():
                        yield from passed(held[:, ~last])
                        held = held[:, last]
                    if held.shape[1] >= HELD:
                        open_key = held[0, 0]
                        yield close(held, False)
                        held = none
            held = np.concatenate([held, *waiting], axis=1)
            if not begun and held.shape[1]:
                open_key = held[0, 0]
            if open_key is not None:
                own = held[0] == open_key
                yield close(held[:, own], True)
                held = held[:, ~own]
            if held.shape[1]:
                last = held[0] == held[0, -1]
                if not last.all():
                    yield from passed(held[:, ~last])
                yield close(held[:, last], True)

        return run

    parts = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_keys = keys.repartitionByRange(parts, "key", "node").sortWithinPartitions("key", "node")
    found = common.materialize(common.map_arrow(sorted_keys, pass_by(True), schema), "near-candidates")
    cut = found.where(F.col("key").isNotNull() & F.col("n").isNotNull()).select("key", F.col("u").alias("node"), "n", "s1", "s2")
    again = common.map_arrow(cut.repartition("key").sortWithinPartitions("key", "node"), pass_by(False), schema)
    pairs = found.where(F.col("key").isNull()).select("u", "v", F.col("n").alias("led")).union(again.where("v is not null").select("u", "v", F.lit(1).cast("long")))
    pairs = common.materialize(pairs.groupBy("u", "v").agg(F.max("led").alias("led")), "near-pairs")
    large = common.materialize(found.where(F.col("nodes").isNotNull()).select("key", "nodes"), "near-large")
    common.release(found)
    return pairs, large


def allowed(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs with whether their bitmaps allow the similarity, as column ``close``."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("bits").alias(f"b{x}")).hint("merge")
    both = pairs.join(side("v"), "v").join(side("u"), "u").select("u", "v", "led", (F.col("nu") + F.col("nv")).alias("total"), "bu", "bv")
    types = {"u": pa.int64(), "v": pa.int64(), "led": pa.int64(), "close": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (by_width(batch.column(c).to_pylist()) for c in (4, 5))
            total, differ = np.asarray(batch.column(3)).astype(np.int64), np.zeros(batch.num_rows, np.int64)
            for w, (i, x) in u.items():
                for w2, (j, y) in v.items():
                    _, a, b = np.intersect1d(i, j, assume_unique=True, return_indices=True)
                    least = min(w, w2)
                    differ[i[a]] = np.bitwise_count(folded(x[a], least) ^ folded(y[b], least)).sum(1)
            yield common.arrow_batch({"u": batch.column(0), "v": batch.column(1), "led": batch.column(2), "close": may_link(differ, total, percent)}, types)

    return common.materialize(common.map_arrow(both, run, "u long, v long, led long, close boolean"), "near-allowed")


def orphans(pairs: DataFrame, links: DataFrame, named: DataFrame) -> DataFrame:
    """(node): of tried pairs of large buckets that are in two components, the node of the smaller one."""
    sizes = common.materialize(named.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "near-sizes")
    known = common.materialize(named.join(sizes.hint("merge"), "component").select("node", "component", "size"), "near-known")
    apart = pairs.where("led = 1").join(links.hint("merge"), ["u", "v"], "left_anti").select("u", "v")
    for x in ("u", "v"):
        side = known.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"), F.col("size").alias(f"s{x}"))
        apart = apart.join(side.hint("merge"), x, "left").withColumns({f"c{x}": F.coalesce(f"c{x}", x), f"s{x}": F.coalesce(f"s{x}", F.lit(1))})
    less = F.when((F.col("su") < F.col("sv")) | ((F.col("su") == F.col("sv")) & (F.col("u") > F.col("v"))), F.col("u")).otherwise(F.col("v"))
    out = common.materialize(apart.where("cu <> cv").select(less.alias("node")).distinct(), "near-orphans")
    common.release(sizes, known)
    return out


def partners(classes: DataFrame, large: DataFrame, nodes: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """(u, v, led), u < v: of the nodes and all sets of other components in their large buckets, the pairs that the bitmaps allow."""
    member = large.select("key", F.explode("nodes").alias("node")).distinct()
    count = lambda df, what, c: df.groupBy("key").agg(F.ceil(F.sum(what) / PART).cast("int").alias(c))
    asks = member.join(nodes.hint("merge"), "node").withColumn("one", F.lit(1))
    squares = common.materialize(count(asks, "one", "rows").join(count(large, F.size("nodes"), "columns").hint("merge"), "key"), "near-squares")
    info = classes.select("node", F.col("n_shingles").alias("n"), "bits").join(named.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    info = info.join(nodes.withColumn("asks", F.lit(True)).hint("merge"), "node", "left")
    rows = member.join(squares.hint("merge"), "key").join(info.hint("merge"), "node")
    # a set stands in every square of its column, and one that asks in every square of its row as well
    part = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    place = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.alias("role"))
    rows = rows.withColumns({"asks": F.coalesce("asks", F.lit(False)), "p": part("rows"), "q": part("columns")})
    down = F.transform(every("rows"), lambda i: place(i, F.col("q"), F.when(F.col("asks") & (i == F.col("p")), BOTH).otherwise(OTHER)))
    across = F.transform(F.filter(every("columns"), lambda j: F.col("asks") & (j != F.col("q"))), lambda j: place(F.col("p"), j, F.lit(ASKS)))
    rows = rows.select("key", F.explode(F.concat(down, across)).alias("at"), "node", "n", "component", "bits").select("key", "at.i", "at.j", "at.role", "node", "n", "component", "bits")

    def compare(x: np.ndarray, bitmaps: list[bytes]) -> tuple[list[int], list[int]]:
        """x: rows role, node, n, component of one square."""
        asks, others = np.flatnonzero(x[0] != OTHER), np.flatnonzero(x[0] != ASKS)
        u, v = [], []
        right = by_width([bitmaps[k] for k in others.tolist()]).items()
        for w, (i, a) in by_width([bitmaps[k] for k in asks.tolist()]).items():
            for w2, (j, b) in right:
                least, n, m = min(w, w2), x[2, asks[i]], x[2, others[j]]
                if 100 * n.max() < percent * m.min() or 100 * m.max() < percent * n.min():
                    continue
                left, other, q = folded(a, least), folded(b, least), others[j]
                for k, p in enumerate(asks[i].tolist()):
                    fit = np.flatnonzero((x[3, q] != x[3, p]) & (100 * np.minimum(x[2, q], x[2, p]) >= percent * np.maximum(x[2, q], x[2, p])))
                    differ = np.bitwise_count(other[fit] ^ left[k]).sum(1).astype(np.int64)
                    hit = x[1, q[fit[may_link(differ, x[2, q[fit]] + x[2, p], percent)]]]
                    u += np.minimum(hit, x[1, p]).tolist()
                    v += np.maximum(hit, x[1, p]).tolist()
        return u, v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ints, bitmaps = None, [], []

        def close():
            u, v = compare(np.concatenate(ints, axis=1), bitmaps)
            ints.clear(), bitmaps.clear()
            return common.arrow_batch({"u": u, "v": v}, {"u": pa.int64(), "v": pa.int64()})

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in range(7)])
            cuts = [0, *(np.flatnonzero(np.diff(x[:3], axis=1).any(0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if tuple(x[:3, i]) != at:
                    if ints:
                        yield close()
                    at = tuple(x[:3, i])
                ints.append(x[3:, i:j])
                bitmaps += batch.column(7).slice(i, j - i).to_pylist()
        if ints:
            yield close()

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = common.map_arrow(dealt, run, "u long, v long").distinct().withColumn("led", F.lit(1).cast("long"))
    found = common.materialize(found, "near-more")
    common.release(squares)
    return found


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the similarity."""
    nodes = common.materialize(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "near-nodes")
    rows = common.keep_ids(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), nodes, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table()
        for batch in common.blocks(batches):
            sets = [shingles(table, t, k).view(np.int64) for t in common.raw_texts(batch)]
            yield common.arrow_batch({"node": batch.column(0), "own": sets}, {"node": pa.int64(), "own": pa.list_(pa.int64())})

    sets = common.materialize(common.map_arrow(rows, run, "node long, own array<long>"), "near-sets")
    both = pairs.join(sets.select(F.col("node").alias("v"), F.col("own").alias("sv")).hint("merge"), "v")
    both = both.join(sets.select(F.col("node").alias("u"), F.col("own").alias("su")).hint("merge"), "u")
    same = F.size(F.array_intersect("su", "sv"))
    both = both.select("u", "v", same.alias("i"), (F.size("su") + F.size("sv")).alias("n"))
    out = common.materialize(both.where(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("u", "v"), "near-links")
    common.release(nodes, sets)
    return out


def components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    sk = common.materialize(sketches(docs, k), "near-sketches")
    first = lambda c: F.first(c).alias(c)  # noqa: E731  equal in all rows of a class
    columns = ("n_shingles", "a", "b", "s1", "s2", "bits")
    grouped = sk.where("n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("node"), *map(first, columns))
    classes = common.materialize(grouped, "near-classes")
    known = classes.where(F.col("node").isNotNull())
    tried, large = candidates(table_keys(known), percent)
    pairs = allowed(tried, known, percent)
    links = confirmed(pairs.where("close").select("u", "v"), docs, k, percent)
    named = common.connected_components(links, "near-cc")
    apart = orphans(pairs, links, named)
    if apart.limit(1).count():
        more = partners(known, large, apart, named, percent)
        new = confirmed(more.select("u", "v"), docs, k, percent)
        if new.limit(1).count():
            was, named = named, common.connected_components(links.union(new), "near-cc")
            common.release(was)
        common.release(more, new)
    common.release(tried, large, pairs, links, apart)
    found = classes.select("set_hash", "node").join(named.hint("merge"), "node", "left").select("set_hash", F.coalesce("component", "node").alias("component"))
    found = common.materialize(found, "near-found")
    common.release(classes, named)
    some = sk.where("n_shingles > 0").select("doc_id", "n_shingles", "set_hash").join(found.hint("merge"), "set_hash")
    none = sk.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    out = some.select("doc_id", "n_shingles", "component").union(none)
    out = out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"))
    return common.reading(out, sk, found)


def drop_near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents that stay, one of each component, with all their columns."""
    found = components(docs, k, percent)
    gone = common.materialize(found.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "near-gone")
    common.release(found)
    return common.reading(common.keep_ids(docs, gone, "doc_id", "left_anti"), gone)
