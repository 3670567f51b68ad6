"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

1. Each text becomes the set of its shingles' 64-bit hashes, a key of the whole set, and one minimum per bin. Empty
   bins borrow from bins picked by a hash of (bin, attempt) alone, so that two texts borrow alike.
2. Texts with equal sets are one class, represented by the smallest doc_id; only representatives go on.
3. Six bins together are a bucket key (42 of them). In each bucket the member that shares most places with others
   is the centre, and every other member gets one edge to it. Buckets of two keys, four keys and eight keys together are
   split the same way. So a bucket of n members has n - 1 edges at each level, whatever its size.
4. The full shingle sets of the texts that share a bucket are written once, and every edge is confirmed on them.
   Members of a bucket that ended in more than one component meet again around other centres.
5. What then still spans components is searched whole: the members of such a bucket outside its largest component meet all
   members of other components, in blocks of bounded size. Shingles that no other component has bound what a text can
   share: texts that nothing in their bucket can be linked with are left out before they are dealt, and pairs by the same
   bound, by sizes and by the bins in which they differ, all of which are exact. The rest are confirmed in place, and only
   links that join components leave a block. So every pair that shares a bucket is in one component in the end, or found
   not to be a link.
6. Components come from alternating neighbour and pointer steps on the confirmed edges.

Null texts and texts without words have no shingles and are linked with nothing. Rows without doc_id come back with a
null component and are not kept. Rows that share a doc_id are judged each by its own text; where the smallest doc_id of
two different texts is the same, they count as linked. Equal rows have equal results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, dropped, in_batches, mixed, shingle_set, staged

BANDS, ROWS = 42, 6
BINS = BANDS * ROWS
LEVELS = (1, 2, 4, 8)
#: Rows of a block in the search of step 5.
BLOCK = 500
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@cache
def lenders(attempt: int) -> np.ndarray:
    """The bin that each empty bin asks at an attempt."""
    return (mixed(np.arange(BINS, dtype=np.uint64) * GOLDEN + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row for each sorted set: one minimum per bin of one permutation; empty bins are filled by optimal densification.

    Hashes are dealt to bins by their upper half, so that a sorted set lies in the order of its bins. An empty set
    has zeros.
    """
    out, there = np.zeros((len(sets), BINS), np.uint64), np.zeros((len(sets), BINS), bool)
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    place = np.repeat(np.arange(len(sets)) * BINS, sizes) + ((flat >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    out.ravel()[place[first]] = flat[first]
    there.ravel()[place[first]] = True
    row, bins = np.nonzero(~there & (sizes > 0)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        source = lenders(attempt)[bins]
        found = there[row, source]
        out[row[found], bins[found]] = mixed(out[row[found], source[found]] + np.uint64(attempt))
        row, bins = row[~found], bins[~found]
    return out


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """The bucket keys of each row of signatures."""
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sigs), BANDS))
    for k in range(ROWS):
        keys = mixed(keys * GOLDEN + sigs[:, k::ROWS])
    return keys.view(np.int64)


def shingles_of(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    return shingle_set(hashes.of(text.encode("utf-8", "surrogatepass").lower().split() if text else []), width)


def set_key(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes; null where there are no shingles), keys (bands) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def begin():
        hashes = WordHashes()

        def work(batch: pa.RecordBatch) -> dict:
            sets = [shingles_of(t, width, hashes) for t in batch.column("text").to_pylist()]
            keys = band_keys(signatures(sets))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
            return {"doc_id": batch.column("doc_id"), "n_shingles": list(map(len, sets)), "set_key": list(map(set_key, sets)), "keys": keys}

        return work

    return in_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), schema, begin, 500)


def shared_keys(representatives: DataFrame) -> DataFrame:
    """(key, id, j, weight) of band keys that at least two representatives have; j: the band, weight: how many have it."""
    every = representatives.select("id", F.posexplode("keys").alias("j", "key"))
    common = every.groupBy("key").agg(F.count(F.lit(1)).alias("weight")).where("weight > 1")
    return every.join(common, "key").select("key", "id", "j", "weight")


def all_levels(shared: DataFrame, members: DataFrame) -> DataFrame:
    """(level, key, id, central): a row of each level for each shared key; central: how many places an id shares."""
    keyed = members.join(shared.groupBy("id").agg(F.sum("weight").alias("central")), "id").select("id", "keys", "central")
    further = lambda level: [F.get(F.col("keys"), (F.col("j") + k) % BANDS) for k in range(1, level)]
    levels = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), (F.col("key") if n == 1 else F.xxhash64(F.col("key"), *further(n), F.lit(n))).alias("key")) for n in LEVELS]))
    return shared.join(keyed, "id").select("id", "central", levels.alias("x")).select("x.level", "x.key", "id", "central")


def own_minima(sets: list[np.ndarray]) -> np.ndarray:
    """A row for each sorted set: a byte of the minimum of each bin, never 0; 0 where the bin is empty.

    Where two sets have different bytes, a shingle of that bin is in one of them alone.
    """
    out = np.zeros((len(sets), BINS), np.uint8)
    for k, s in enumerate(sets):
        bins, first = np.unique((s >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32), return_index=True)
        out[k, bins.astype(np.int64)] = (s[first] % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    return out


def full_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(id, n, shingles, minima, keys) of the members (id, set_key, keys): sorted 64-bit hashes, own_minima, bucket keys."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("shingles", pa.binary()), ("minima", pa.binary())])

    def begin():
        hashes = WordHashes()

        def work(batch: pa.RecordBatch) -> dict:
            sets = [shingles_of(t, width, hashes) for t in batch.column("text").to_pylist()]
            minima = own_minima(sets)
            return {"id": batch.column("id"), "n": list(map(len, sets)), "set_key": list(map(set_key, sets)), "shingles": [s.tobytes() for s in sets], "minima": [m.tobytes() for m in minima]}

        return work

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).join(members.select("id").distinct(), "id", "left_semi")
    got = in_batches(texts, schema, begin, 500).join(members.select("id", "set_key", "keys"), ["id", "set_key"])
    return got.groupBy("id", "set_key").agg(*[F.first(c).alias(c) for c in ("n", "shingles", "minima", "keys")]).drop("set_key")


def stars(rows: DataFrame, centrality: str) -> DataFrame:
    """Edges (a, b), a < b, from each bucket's centre to its other members; rows: key, id and the centrality column."""
    centres = rows.groupBy("key").agg(F.max(F.struct(F.col(centrality), (-F.col("id")).alias("id"))).alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", (-F.col("c.id")).alias("centre"))
    pairs = rows.select("key", "id").join(centres, "key").where("id <> centre")
    return pairs.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def linked(left: np.ndarray, right: np.ndarray, share: int) -> bool:
    """Whether two sorted sets agree in at least `share` hundredths of their union."""
    union = np.concatenate([left, right])
    union.sort()
    common = int(np.count_nonzero(union[1:] == union[:-1]))
    return 100 * common >= share * (len(union) - common)


def confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs whose full shingle sets agree in at least `share` hundredths of their union."""
    side = lambda end: sets.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("shingles").alias(f"s_{end}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * share)

    def begin():
        def work(batch: pa.RecordBatch) -> dict:
            pairs_here = zip(batch.column("s_a"), batch.column("s_b"), strict=True)
            kept = pa.array([linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), share) for x, y in pairs_here], pa.bool_())
            return {k: batch.column(k).filter(kept) for k in ("a", "b")}

        return work

    return in_batches(both.select("a", "b", "s_a", "s_b"), PAIR, begin).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the edges; component: the smallest id reachable."""
    both = staged(edges.select(F.col("a").alias("id"), F.col("b").alias("other")).union(edges.select("b", "a")))
    labels = staged(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")))
    moved = True
    while moved:
        seen = both.join(labels.select(F.col("id").alias("other"), F.col("component").alias("theirs")), "other").groupBy("id").agg(F.min("theirs").alias("theirs"))
        hooked = labels.join(seen, "id").select("id", F.col("component").alias("was"), F.least("component", "theirs").alias("c"))
        up = labels.select(F.col("id").alias("c"), F.col("component").alias("further"))
        after = staged(hooked.join(up, "c").select("id", F.least("c", "further").alias("component"), (F.least("c", "further") != F.col("was")).alias("moved")))
        moved = bool(after.where("moved").limit(1).count())
        dropped(labels)
        labels = after
    dropped(both)
    return labels


def more_stars(rows: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Edges between components that still share buckets, around a centre that differs from turn to turn."""
    labelled = rows.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    centre = F.max(F.struct(F.xxhash64("id", F.lit(turn)).alias("turn"), F.col("id"), F.col("component")))
    split = labelled.groupBy("key").agg(centre.alias("c"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    pairs = labelled.join(split.select("key", "c"), "key").where("component <> c.component")
    return pairs.select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct()


def exclusive(sets: DataFrame, labelled: DataFrame) -> DataFrame:
    """(id, own): how many shingles of each id no other component has; ids without any are left out. labelled: id, component."""

    def begin():
        def work(batch: pa.RecordBatch) -> dict:
            flat = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.int64)
            of = pa.array(np.repeat(np.arange(batch.num_rows), batch.column("n").to_numpy()))
            return {"id": batch.column("id").take(of), "component": batch.column("component").take(of), "h": pa.array(flat)}

        return work

    schema = pa.schema([("id", pa.int64()), ("component", pa.int64()), ("h", pa.int64())])
    every = in_batches(sets.join(labelled, "id").select("id", "component", "n", "shingles"), schema, begin, 500)
    alone = every.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low = high").select("h")
    return every.join(alone, "h").groupBy("id").agg(F.count(F.lit(1)).alias("own"))


def joining_links(shared: DataFrame, labels: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """(a, b), written: links that join all components of which two members share a bucket and are a link.

    Two sets are a link only if (100 + share) * |difference| <= (100 - share) * (n_a + n_b), the difference being
    symmetric; the shingles that each has for its component alone are a part of it. So `slack`, what these use up beyond
    a set's own share, must not be above 0 for both together, and a row whose slack is too large for the least of its
    bucket has no link there. In each bucket that still spans components, members outside the largest one are dealt into
    blocks of about BLOCK rows, and so are its members. Every block of the former meets every block, two blocks at a
    time, so that memory is bounded; of a bucket that one component fills but for k members, each row comes k / BLOCK + 1
    times. A pair is looked at in the first bucket that it shares, and confirmed on full sets unless its sizes, slacks or
    minima exclude a link, or a link found there has joined its components already: so the links of a run are fewer than
    its rows.
    """
    labelled = shared.join(labels, "id", "left").select("key", "j", "id", F.coalesce("component", "id").alias("component"))
    span = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    spanning = staged(labelled.join(span, "key"))
    ids = spanning.select("id", "component").distinct()
    # Where an id stands for several texts, nothing is its own, and the longest counts.
    slack = (100 + share) * F.when(F.col("texts") == 1, F.coalesce("own", F.lit(0))).otherwise(0) - (100 - share) * F.col("n")
    lengths = sets.join(ids.select("id"), "id", "left_semi").groupBy("id").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    slacks = staged(lengths.join(exclusive(sets, ids), "id", "left").select("id", slack.alias("slack")))
    least = spanning.join(slacks, "id")
    least = least.join(least.groupBy("key").agg(F.min("slack").alias("least")), "key")
    labelled = staged(least.where("slack + least <= 0").drop("least"))
    sizes = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK)
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all")).where("all > main.n")
    split = main.select("key", F.col("main.component").alias("main"), blocks(F.col("all") - F.col("main.n")).alias("outer"), blocks(F.col("main.n")).alias("inner"))
    met = staged(labelled.join(split, "key").withColumn("outside", F.col("component") != F.col("main")))
    block = F.pmod(F.xxhash64("id"), F.when(F.col("outside"), F.col("outer")).otherwise(F.col("inner")))
    place = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    last = F.col("outer") + F.col("inner") - 1
    own = F.transform(F.sequence(F.col("block"), last), lambda y: place(F.col("block"), y))
    before = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("block")), lambda x: x < F.col("block")), lambda x: place(x, F.col("block")))
    inner = F.transform(F.sequence(F.lit(0).cast("long"), F.col("outer") - 1), lambda x: place(x, F.col("outer") + F.col("block")))
    places = F.explode(F.when(F.col("outside"), F.concat(own, before)).otherwise(inner))
    dealt = met.withColumn("block", block).select("key", "j", "id", "component", "slack", F.col("outside").alias("first"), "block", places.alias("p"))
    dealt = dealt.select("key", "p.x", "p.y", "j", (F.col("first") & (F.col("block") == F.col("p.x"))).alias("first"), "id", "component", "slack")
    order = ["key", "x", "y"]
    runs = dealt.join(sets, "id").repartition(*order).sortWithinPartitions(*order).select(*order, "j", "first", "id", "component", "slack", "n", "keys", "minima", "shingles")

    def links_of(run: pa.Table) -> dict[str, list[int]]:
        ids, component, n, slack, first = (run.column(c).to_numpy() for c in ("id", "component", "n", "slack", "first"))
        keys = run.column("keys").combine_chunks().flatten().to_numpy().reshape(len(ids), BANDS)
        minima = np.frombuffer(b"".join(run.column("minima").to_pylist()), np.uint8).reshape(len(ids), BINS)
        full, band = run.column("shingles"), run.column("j")[0].as_py()
        alone = run.column("x")[0].as_py() == run.column("y")[0].as_py()
        right = np.arange(len(ids)) if alone else np.flatnonzero(~first)
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        found: dict[str, list[int]] = {"a": [], "b": []}
        for k in np.flatnonzero(first):
            other = right[(component[right] != component[k]) & (100 * np.minimum(n[right], n[k]) >= share * np.maximum(n[right], n[k]))]
            other = other[other > k] if alone else other
            other = other[slack[other] + slack[k] <= 0]
            other = other[(keys[other] == keys[k]).argmax(1) == band]
            differ = np.count_nonzero(minima[other] != minima[k], axis=1)
            other = other[(100 + share) * differ <= (100 - share) * (n[other] + n[k])]
            mine = np.frombuffer(full[k].as_buffer(), np.uint64) if len(other) else None
            for o in other.tolist():
                c, d = root(int(component[k])), root(int(component[o]))
                if c != d and linked(mine, np.frombuffer(full[o].as_buffer(), np.uint64), share):
                    joined[c] = d
                    found["a"].append(min(int(ids[k]), int(ids[o])))
                    found["b"].append(max(int(ids[k]), int(ids[o])))
        return found

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal (key, x, y) lie side by side; the last one of a batch may go on in the next."""
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.concat_tables([*held, pa.Table.from_batches([batch])]).combine_chunks()
            if not table.num_rows:
                continue
            marks = [table.column(c).to_numpy() for c in order]
            starts = np.flatnonzero(np.concatenate([[True], np.any([m[1:] != m[:-1] for m in marks], axis=0)]))
            for start, stop in zip(starts[:-1], starts[1:], strict=True):
                yield pa.RecordBatch.from_pydict(links_of(table.slice(start, stop - start)), PAIR)
            held = [table.slice(starts[-1])]
        for rest in held:
            yield pa.RecordBatch.from_pydict(links_of(rest), PAIR)

    out = staged(runs.mapInArrow(search, "a long, b long").distinct())
    dropped(spanning, slacks, labelled, met)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, share: int = 80, turns: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; links at a Jaccard similarity of share/100 or more.

    turns: rounds of further stars before what still spans components is searched whole. They only save work.
    """
    sketch = staged(sketches(docs, width))
    keyed = sketch.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = staged(keyed.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys")))
    shared = staged(shared_keys(classes))
    members = staged(classes.join(shared.select("id").distinct(), "id", "left_semi"))
    rows = staged(all_levels(shared, members))
    sets = staged(full_sets(docs, members, width))
    tested = staged(stars(rows, "central"))
    links = staged(confirmed(tested, sets, share))
    labels = components(links)
    for turn in range(turns):
        fresh = staged(more_stars(rows, labels, turn).join(tested, ["a", "b"], "left_anti"))
        found = staged(confirmed(fresh, sets, share))
        before = tested, links, fresh, found, labels
        tested, links = staged(tested.union(fresh)), staged(links.union(found))
        labels = components(links)
        dropped(*before)
    found = joining_links(shared, labels, sets, share)
    before = tested, links, found, labels
    links = staged(links.union(found))
    labels = components(links)
    named = classes.select("set_key", "id").join(labels, "id", "left").select("set_key", F.coalesce("component", "id").alias("component_id"))
    alone = F.encode(F.concat(F.lit("alone "), F.monotonically_increasing_id().cast("string")), "utf-8")
    slim = sketch.select("doc_id", "n_shingles", F.coalesce("set_key", alone).alias("set_key"))
    out = slim.join(named, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    dropped(*before, links, shared, members, rows, sets)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
