"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints that differ in at most r bits are found so: the bits are dealt to m partitions, correlated bits
together; partition i gets a threshold t_i >= -1 with sum(t_i) = r - m + 1. Two fingerprints within r then
differ in at most t_i bits of some partition i (t_i = -1: never looked at). Thresholds and m come from dynamic
programming on candidate counts estimated from a bounded sample of fingerprints; every fingerprint is indexed
under its bits of each partition and probes all values within the threshold. What meets is verified on all bits.

Equal fingerprints are one node before that, buckets give a spanning forest of their links instead of all
pairs, and a bucket above `block` rows is cut into pairs of blocks, each a bucket of its own.

Texts alike by their sets of shingles differ in a share of the bits, not in a few: `one_of_each` takes wide fingerprints, whose
partitions and thresholds are chosen by the chance that such a pair is missed (`plan_share`).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import LOWER, integral, slices, staged, without
from skyframe.llm.components import components

_ONES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes | None, ngram: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `ngram` words, repeats included; fewer words: of the whole sequence; none: empty."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= ngram:
        return np.array([digest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - ngram + 1].tolist(), (ends[ngram - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)


def _lane(hashes: np.ndarray, j: int) -> np.ndarray:
    """The hash itself (j = 0), or one of further 64-bit mixes of it."""
    if not j:
        return hashes
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * j) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhashes(hashes: list[np.ndarray], bits: int = 64) -> np.ndarray:
    """Majority fingerprints of the documents' shingle hashes, (documents, bits / 64) of uint64."""
    lanes = bits // 64
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    out = np.zeros((len(hashes), lanes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    x, sizes = np.concatenate([hashes[i] for i in full]), sizes[full]
    # Sums of up to 255 rows fit in the eight byte lanes of a uint64, for one bit of every byte at a time.
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    blocks = [np.arange(b, b + n, 255) for b, n in zip(begins, sizes, strict=True)]
    first_block = np.concatenate([[0], np.cumsum([len(b) for b in blocks])[:-1]])
    cuts = np.concatenate(blocks)
    for j in range(lanes):  # one lane at a time: memory is that of one
        lane, counts = _lane(x, j), np.empty((len(full), 8, 8), dtype=np.int64)  # [document, byte, bit]
        for bit in range(8):
            part = np.add.reduceat((lane >> np.uint64(bit)) & _ONES, cuts)
            counts[..., bit] = np.add.reduceat(part.view(np.uint8).reshape(len(cuts), 8).astype(np.int64), first_block, axis=0)
        majority = counts * 2 > sizes[:, None, None]
        out[full, j] = np.packbits(majority, axis=-1, bitorder="little").reshape(len(full), 8).view(np.uint64)[:, 0]
    return out


def _fingerprint(ngram: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, size=1_000_000):
            prints = simhashes([shingle_hashes(t, ngram) for t in texts], bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in prints], pa.binary())], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, bits: int = 64) -> DataFrame:
    """(id long, fp binary): little-endian 64-bit words. Null texts and texts without words have fingerprint zero.

    Ids are whole numbers or null; any others raise a TypeError.
    """
    rows = docs.select(integral(docs, id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint(ngram, bits), "id long, fp binary")


def _bits(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")


def _keys(bits: np.ndarray, places: list[int]) -> np.ndarray:
    return bits[:, places].astype(np.uint64) @ (np.uint64(1) << np.arange(len(places), dtype=np.uint64))


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bits to m partitions of near-equal width: each takes, one by one, the free bit that correlates most with its own."""
    bits = _bits(sample).astype(np.float64)
    n = bits.shape[1]
    spread = bits - bits.mean(axis=0)
    norm = np.sqrt((spread**2).sum(axis=0)) + 1e-9
    close = np.abs(spread.T @ spread) / norm[:, None] / norm[None, :]
    np.fill_diagonal(close, 0)
    free, parts = set(range(n)), []
    for i in range(m):
        part = [max(sorted(free), key=lambda b: close[b].max())]
        free.remove(part[0])
        while len(part) < n // m + (i < n % m):
            best = max(sorted(free), key=lambda b, p=part: close[b, p].sum())
            part.append(best)
            free.remove(best)
        parts.append(sorted(part))
    return parts


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds t_i >= -1 with sum `total` of least cost; costs[i][t + 1] is partition i's cost at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t in range(-1, len(cost) - 1):
                if s + t not in step or c + cost[t + 1] < step[s + t][0]:
                    step[s + t] = (c + cost[t + 1], [*ts, t])
        best = step
    return best[total][1]


def plan(sample: np.ndarray, n: int, radius: int, sizes: tuple[int, ...], row_cost: float = 300.0, most: int = 3) -> list[tuple[list[int], int]]:
    """(bits, threshold) per partition for n fingerprints; of the partition counts in `sizes` the cheapest.

    Cost of a threshold: estimated candidate pairs, and `row_cost` pairs' worth for each probe row. Estimates
    come from all pairs of the sample, never below those of even bits.
    """
    options = []
    for m in sizes:
        parts = group_bits(sample, m)
        bits, costs = _bits(sample), []
        for places in parts:
            keys, w = _keys(bits, places), len(places)
            values, counts = np.unique(keys, return_counts=True)
            near = np.bincount(np.bitwise_count(values[:, None] ^ values[None, :]).ravel(), weights=(counts[:, None] * counts[None, :]).ravel(), minlength=w + 1)
            near[0] -= len(sample)
            seen = np.cumsum(near) / max(1, len(sample) * (len(sample) - 1))
            ball = [sum(comb(w, j) for j in range(t + 1)) for t in range(min(most, radius) + 1)]
            costs.append([0.0] + [n * n / 2 * max(seen[t], ball[t] / 2**w) + row_cost * n * ball[t] for t in range(len(ball))])
        if radius - m + 1 >= -m:
            ts = allocate(costs, radius - m + 1)
            options.append((sum(c[t + 1] for c, t in zip(costs, ts, strict=True)), [(p, t) for p, t in zip(parts, ts, strict=True) if t >= 0]))
    return min(options, key=lambda o: o[0])[1]


def cover(costs: list[list[float]], gains: list[float], total: float, units: int = 2000) -> list[int] | None:
    """Thresholds t_i >= -1 of least cost whose gains (0 at -1, gains[t] at t) sum to `total` at least; None: there are none."""
    up = [0] + [int(g / total * units) for g in gains]
    best = np.full(units + 1, np.inf)
    best[0], taken = 0.0, []
    at = np.arange(units + 1)
    for cost in costs:
        step, how = best.copy(), np.zeros(units + 1, dtype=np.int64)
        for t in range(1, len(up)):
            new = np.full(units + 1, np.inf)
            np.minimum.at(new, np.minimum(at + up[t], units), best + cost[t])
            how[new < step] = t
            step = np.minimum(step, new)
        taken.append((best, how))
        best = step
    if not np.isfinite(best[units]):
        return None
    left, out = units, []
    for cost, (before, how) in zip(reversed(costs), reversed(taken), strict=True):
        t = int(how[left])
        out.append(t - 1)
        if t:
            ends = np.flatnonzero(np.minimum(at + up[t], units) == left)
            left = int(ends[np.argmin(before[ends])])
    return out[::-1]


def plan_share(sample: np.ndarray, n: int, share: float, miss: float, widths: tuple[int, ...], row_cost: float = 400.0) -> list[tuple[list[int], int]]:
    """(bits, threshold) per partition of n wide fingerprints, where near ones differ in a share of their bits and not in a few.

    Pigeonholes for the worst case would probe a good part of all rows. So the thresholds, by dynamic programming, are the cheapest for which
    a pair whose bits each differ with chance `share` is within the threshold of no partition with a chance of `miss` at most. The bits of a
    wide fingerprint are of independent hashes, so partitions are runs of bits; costs are as in `plan`, for thresholds up to 1.
    """
    bits, options, pairs = _bits(sample), [], max(1, len(sample) * (len(sample) - 1))
    for w in widths:
        parts = [list(range(at, at + w)) for at in range(0, bits.shape[1] - w + 1, w)]
        within = np.cumsum([comb(w, j) * share**j * (1 - share) ** (w - j) for j in range(2)])
        costs = []
        for places in parts:
            values, counts = np.unique(_keys(bits, places), return_counts=True)
            beside = values[:, None] ^ (np.uint64(1) << np.arange(w, dtype=np.uint64))
            place = np.minimum(np.searchsorted(values, beside), len(values) - 1)
            same = float((counts**2).sum() - len(sample))
            close = same + float((np.where(values[place] == beside, counts[place], 0) * counts[:, None]).sum())
            costs.append([0.0] + [n * n / 2 * max(seen / pairs, ball / 2**w) + row_cost * n * ball for seen, ball in ((same, 1), (close, 1 + w))])
        if ts := cover(costs, [-float(np.log1p(-p)) for p in within], -float(np.log(miss))):
            options.append((sum(c[t + 1] for c, t in zip(costs, ts, strict=True)), [(p, t) for p, t in zip(parts, ts, strict=True) if t >= 0]))
    return min(options, key=lambda o: o[0])[1]


def _sign(parts: list[tuple[list[int], int]], carried: int | None = None):
    """Index rows (probe false) and probe rows of each partition; they carry the fingerprint, or its first `carried` bytes."""
    masks = [[sum(1 << b for b in c) for d in range(1, t + 1) for c in combinations(range(len(p)), d)] for p, t in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1)
            bits = _bits(prints)
            fp = batch.column(1) if carried is None else pa.array([x.tobytes() for x in prints[:, : carried // 8]], pa.binary())
            for i, (places, _) in enumerate(parts):
                key = _keys(bits, places).view(np.int64)
                for mask in [0, *masks[i]]:
                    n = batch.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int32)), pa.array(key ^ np.int64(mask)), pa.array(np.full(n, bool(mask))), batch.column(0), fp], ["part", "key", "probe", "id", "fp"])

    return run


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) places of the components of a symmetric adjacency matrix."""
    out, seen = [], np.zeros(len(near), dtype=bool)
    for root in np.flatnonzero(near.any(axis=1)):
        if seen[root]:
            continue
        seen[root] = True
        edge = np.array([root])
        while len(edge):
            edge = np.flatnonzero(near[edge].any(axis=0) & ~seen)
            seen[edge] = True
            out += [(root, x) for x in edge]
    return out


def _link(radius: int, small: int = 12):
    """Links within buckets; rows come sorted by bucket (the first four columns), a bucket may span batches."""

    def bucket_links(ids, prints, probe, starts):
        a, b = [], []
        sizes = np.diff(starts)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        little = sizes[owner] <= small
        for s in range(1, min(small, sizes.max(initial=1))):
            i = np.flatnonzero((owner[:-s] == owner[s:]) & little[:-s])
            i = i[~(probe[i] & probe[i + s])]
            i = i[np.bitwise_count(prints[i] ^ prints[i + s]).sum(axis=1) <= radius]
            a.append(ids[i])
            b.append(ids[i + s])
        for k in np.flatnonzero(sizes > small):
            lo, hi = starts[k], starts[k + 1]
            far = np.zeros((hi - lo, hi - lo), dtype=np.uint16)
            for lane in prints[lo:hi].T:
                far += np.bitwise_count(lane[:, None] ^ lane[None, :])
            near = (far <= radius) & ~(probe[lo:hi, None] & probe[None, lo:hi])
            np.fill_diagonal(near, False)
            found = np.array(_forest(near), dtype=np.int64).reshape(-1, 2) + lo
            a.append(ids[found[:, 0]])
            b.append(ids[found[:, 1]])
        return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def held() -> Iterator[pa.Table]:
            rest = None
            for batch in batches:
                now = pa.Table.from_batches([batch])
                rest = now if rest is None else pa.concat_tables([rest, now])
                if not rest.num_rows:
                    continue
                k = [rest.column(c).to_numpy() for c in range(4)]
                same = np.logical_and.reduce([c == c[-1] for c in k])
                last = int(np.flatnonzero(~same).max(initial=-1)) + 1
                if last:
                    yield rest.slice(0, last)
                    rest = rest.slice(last)
            if rest is not None and rest.num_rows:
                yield rest

        for t in held():
            k = [t.column(c).to_numpy() for c in range(4)]
            new = np.logical_or.reduce([c[1:] != c[:-1] for c in k])
            starts = np.concatenate([[0], np.flatnonzero(new) + 1, [t.num_rows]])
            prints = np.frombuffer(b"".join(t.column(6).to_pylist()), dtype=np.uint64).reshape(t.num_rows, -1)
            a, b = bucket_links(t.column(5).to_numpy(), prints, t.column(4).to_numpy(zero_copy_only=False), starts)
            keep = a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return run


def links(nodes: DataFrame, guarantee: int, radius: int, sizes: tuple[int, ...], block: int = 1024, sample: int = 2048, most_hot: int = 50_000) -> DataFrame:
    """Links (a, b) of distinct fingerprints (id, fp) that connect all pairs within `guarantee` bits.

    Pairs that meet in a bucket link up to `radius` bits, so a radius above the guarantee finds further pairs.
    A bucket's links are given as a forest. The list of buckets above `block` rows is broadcast up to `most_hot`
    of them and joined beyond that. `sample` bounds what the thresholds are fitted on; all rows are indexed.
    """
    drawn = _drawn(nodes, sample)
    if len(drawn) < 2:
        return nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    return _met(_signed(nodes, plan(drawn, nodes.count(), guarantee, sizes)), radius, block, most_hot)


def _drawn(nodes: DataFrame, sample: int) -> np.ndarray:
    held = nodes.orderBy(F.xxhash64("fp")).limit(sample).select("fp").collect()
    return np.frombuffer(b"".join(bytes(r["fp"]) for r in held), dtype=np.uint64).reshape(len(held), -1 if held else 1)


def _signed(nodes: DataFrame, parts: list[tuple[list[int], int]], carried: int | None = None) -> DataFrame:
    signed = nodes.select("id", "fp").mapInArrow(_sign(parts, carried), "part int, key long, probe boolean, id long, fp binary")
    return signed if any(t for _, t in parts) else signed.drop("probe").withColumn("probe", F.lit(False))


def links_of_share(nodes: DataFrame, share: float, miss: float, radius: int, carried: int, widths: tuple[int, ...] = tuple(range(6, 15)), sample: int = 2048) -> DataFrame:
    """Links (a, b) of distinct wide fingerprints (id, fp) that connect the pairs whose bits each differ with a chance of `share` or less,
    but for a part `miss` of them at most.

    Every row is indexed under its bits of each partition (`plan_share`) and probes what is within the threshold. What meets is
    linked where the first `carried` bytes differ in at most `radius` bits.
    """
    drawn = _drawn(nodes, sample)
    if len(drawn) < 2:
        return nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    return _met(_signed(nodes, plan_share(drawn, nodes.count(), share, miss, widths), carried), radius)


def _met(signed: DataFrame, radius: int, block: int = 1024, most_hot: int = 50_000) -> DataFrame:
    """Links within the buckets (part, key) of signed (part, key, probe, id, fp)."""
    hot = staged(signed.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).select("part", "key", "blocks"), "hot-buckets")
    few = hot.limit(most_hot + 1).count() <= most_hot
    met = signed.join(F.broadcast(hot) if few else hot.hint("merge"), ["part", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("part", "key", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "probe", "id", "fp")
    bucket = ["part", "key", "b1", "b2"]
    return met.repartition(*bucket).sortWithinPartitions(*bucket).mapInArrow(_link(radius), "a long, b long").distinct()


def near_duplicates(prints: DataFrame, guarantee: int = 3, radius: int | None = None, sizes: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """(id, fp, component_id) per row of prints (id long, fp binary).

    component_id is the least id reachable over links, itself included; without other documents it is the own
    id. Rows that repeat an id are one document if their fingerprints are equal, else both link under it: what either is near
    to is reachable from it. A null id is linked to nothing and keeps a null component. An empty table stays empty.
    """
    prints = staged(prints, "fingerprints")
    known = prints.filter(F.col("id").isNotNull())
    nodes = staged(known.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    found = links(nodes, guarantee, guarantee if radius is None else radius, sizes)
    several = known.groupBy("id").agg(F.min("fp").alias("one"), F.max("fp").alias("other")).filter("one != other").select(F.col("id").alias("a"))
    under = known.select(F.col("id").alias("a"), "fp").distinct().join(several.hint("merge"), "a", "left_semi")
    under = under.join(nodes.select("fp", F.col("id").alias("b")).hint("merge"), "fp").select("a", "b")
    roots = components(found.union(under))
    by_print = nodes.join(roots.hint("merge"), "id", "left").select(F.col("fp"), F.coalesce("root", "id").alias("component_id"))
    out = prints.join(by_print.hint("merge"), "fp", "left")
    return out.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def _shingled(ngram: int, bits: int):
    """Per document: digest of its set of shingles, and fingerprint of the set (null: no shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, size=1_000_000):
            sets = [np.unique(shingle_hashes(t, ngram)) for t in texts]
            digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            prints = [fp.tobytes() if len(x) else None for x, fp in zip(sets, simhashes(sets, bits), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(prints, pa.binary())], ["id", "digest", "fp"])

    return run


def similar(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(root, member) places of the components of sets (sorted, not empty) with a Jaccard similarity of 4/5 or more."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    out, seen = [], np.zeros(len(sets), dtype=bool)
    for root in range(len(sets)):
        if seen[root]:
            continue
        seen[root] = True
        edge = [root]
        while edge and not seen.all():
            k = edge.pop()
            own = np.zeros(len(values), dtype=np.int64)
            own[place[begins[k] : begins[k] + sizes[k]]] = 1
            common = np.add.reduceat(own[place], begins)
            near = np.flatnonzero((9 * common >= 4 * (sizes + sizes[k])) & ~seen)
            seen[near] = True
            edge += near.tolist()
            out += [(root, x) for x in near.tolist()]
    return out


def _verify(ngram: int):
    """Links by exact similarity within groups; rows come sorted by group (the first three columns), a group may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links_of(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            found = np.array(similar(sets), dtype=np.int64).reshape(-1, 2)
            a, b = np.array(ids, dtype=np.int64)[found.T]
            return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

        now, ids, sets = None, [], []
        for batch, texts in slices(batches, size=1_000_000):
            for *group, k, t in zip(*(batch.column(c).to_pylist() for c in range(4)), texts, strict=True):
                if group != now:
                    if len(ids) > 1:
                        yield links_of(ids, sets)
                    now, ids, sets = group, [], []
                x = np.unique(shingle_hashes(t, ngram))
                if len(x):
                    ids.append(k)
                    sets.append(x)
        if len(ids) > 1:
            yield links_of(ids, sets)

    return run


def verified(rows: DataFrame, group: DataFrame, ngram: int, block: int = 1024, block_chars: int = 16_000_000, most_hot: int = 50_000) -> DataFrame:
    """Links (a, b) that connect the pairs of rows (id, text) of one group (id, root) whose shingle sets have a Jaccard similarity of 4/5 or more.

    Texts move once, to their group. A group above `block` rows or `block_chars` is cut into pairs of blocks, each a group of its own;
    the list of such groups is broadcast up to `most_hot` of them and joined beyond that.
    """
    held = staged(rows.join(group.hint("merge"), "id").select("root", "id", "text"), "candidates")
    size = held.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / block, F.sum(F.length("text")) / block_chars)).cast("int").alias("blocks"))
    hot = staged(size.filter("blocks > 1"), "hot-groups")
    few = hot.limit(most_hot + 1).count() <= most_hot
    met = held.join(F.broadcast(hot) if few else hot.hint("merge"), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("root", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "id", "text")
    return met.repartition("root", "b1", "b2").sortWithinPartitions("root", "b1", "b2").mapInArrow(_verify(ngram), "a long, b long").distinct()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, bits: int = 2304, carried_bits: int = 256, radius: int = 72, share: float = 0.1875, miss: float = 1e-3) -> DataFrame:
    """The rows of docs without those that a near-duplicate of a smaller id stands for; all their columns.

    Near-duplicates are connected by pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
    Candidates come from partitions of the sets' SimHash fingerprints (`links_of_share`): at a similarity s about
    acos(2s / (1 + s)) / pi of the bits differ, 15.2 % at 0.8, and 18.75 % (`share`) in the worst case, sets of five and four. Thresholds are
    such that one pair in 1,000 is missed there, and 3 in 100,000 at 15.2 %, at any number of documents. Of the 256 bits carried,
    some 39 differ at 0.8, 48 in the worst case; 72 are 28 %, which unlike texts (half) do not come near. The sets
    themselves then decide; equal sets are one node throughout.
    Rows with a null id stay. Texts without words are copies of each other.
    """
    rows = docs.select(integral(docs, id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL")
    prints = staged(rows.mapInArrow(_shingled(ngram, bits), "id long, digest binary, fp binary"), "shingles")
    nodes = staged(prints.groupBy("digest").agg(F.min("id").alias("id"), F.first("fp").alias("fp")), "nodes")
    roots = components(links_of_share(nodes.filter("fp IS NOT NULL"), share, miss, radius, carried_bits // 8))
    group = staged(roots.union(roots.select(F.col("root").alias("id"), "root").distinct()), "groups")
    same = components(verified(rows, group, ngram))
    by_set = nodes.join(same.hint("merge"), "id", "left").select("digest", F.coalesce("root", "id").alias("component_id"))
    found = prints.select("id", "digest").join(by_set.hint("merge"), "digest")
    return without(docs, id_col, found.filter(F.col("id") != F.col("component_id")).select("id"))


def hex_fingerprint(fp):
    """The 16 lower-case hex digits of a 64-bit fingerprint column, most significant first."""
    return F.lower(F.concat(*[F.hex(F.substring(fp, i, 1)) for i in range(8, 0, -1)]))
