"""Near-dedup by a MinHash LSH forest, with every link confirmed on the shingles themselves.

Method. A document's set holds its distinct 5-word shingles (A-Z lower-cased). Rows with equal sets form a class, named
by its smallest doc_id and that row's text, so thousands of copies cost one row. Each class is signed with CODES minhash
values. An order of the forest sorts the classes by these values, beginning at a place of its own; classes are candidates
where they are neighbours in an order with a long common prefix.

How long the prefix must be depends on the region. A region (classes with a common prefix, at first of DEPTHS[0] values)
of more than WIDE classes is split by more values, and again, until it is small enough; its members are then compared
with their neighbours in the order up to the region's ends. A deeper prefix is shared by fewer similar pairs: a pair at
similarity s has d values in common with probability s^d. So the orders grow with the depth: each class adds up the
logarithm of its chance to miss a partner, and as long as that chance is over MISS, it takes part in a further forest
with fresh hash functions. Sparse classes need one forest, classes of dense regions several; no region is cut off.

Before that, neighbours of the first few orders are linked, whatever the regions' sizes (classes of equal values with the
first of them), and the components of the confirmed links are found: most families of near copies are one component each
then, and a region of one component holds no candidates. After each forest its candidates are confirmed and the components
completed before the certainty is counted: a class has a partner to miss only in regions that still hold another component.
Candidates that their signatures put more than five standard deviations under the threshold are ruled out; the others are
confirmed on their shingles, word by word (no hashes). Classes are told apart by the 128-bit BLAKE2b digest of their sets.

Defined results: null and blank texts have an empty set and are linked with nothing; a text of fewer than five words
has one shingle, the whole; rows that share a doc_id are one document, which links whatever its rows link; a null doc_id
is kept unlinked with a null component. Very long texts are handled whole, one at a time. Only doc_id and the text are
read; other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, raw_text, read_table, small_batches
from .graph import components, joined_components
from .words import Words, mix, run_names, window_starts

SHINGLE, CODES = 5, 128
#: Values that a region's members have in common: at first, and after each split.
DEPTHS = (4, 7, 10, 14, 20, 32, 64, CODES)
#: Classes of a region that is not split further; chance to miss a link; orders whose neighbours are linked at first.
WIDE, MISS, FIRST_ORDERS = 64, 1e-5, 3
#: Shingles of a class' partners that one group confirms.
SHOWN = 300_000
#: Further forests grown in one go, at most.
AT_ONCE = 12
_PAIR = "a long, a_key long, b long, b_key long, n_b long"
_ROW = ["forest", "order", "id", "key"]


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes of each shingle of all texts, one text after the other, and how many shingles each text has;
    repeats included. The hashes stir in the two halves of each word's BLAKE2b digest, word after word."""
    names, digests = words.named_digests()
    starts, count = window_starts(words.first, SHINGLE)
    short = (words.count > 0) & (words.count < SHINGLE)
    size = np.where(short, words.count, SHINGLE)
    if short.any():
        count = np.where(short, 1, count)
        begin = np.cumsum(count) - count
        starts = np.arange(int(count.sum())) - np.repeat(begin - words.first[:-1], count)
    size = np.repeat(size, count)
    both = []
    for half in (0, 1):
        of_word = digests[:, half][names]
        h = mix(of_word[starts] + size.astype(np.uint64))
        for k in range(1, SHINGLE):
            if short.any():
                more = np.flatnonzero(size > k)
                h[more] = mix(h[more] ^ of_word[starts[more] + k])
            else:
                h = mix(h ^ of_word[starts + k])
        both.append(h)
    return *both, count


def shingle_sets(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles' two hashes, sorted within each text, and the n + 1 offsets of the texts."""
    raw, offsets = raw_text(column)
    one, two, count = shingles(Words(raw, offsets, fold_case=True))
    ends = np.cumsum(count)
    owner = np.repeat(np.arange(len(count)), count)
    order = np.concatenate([e - c + np.argsort(one[e - c : e]) for e, c in zip(ends.tolist(), count.tolist(), strict=True)]) if len(count) else ends
    same = one[order][1:] == one[order][:-1]
    same &= owner[1:] == owner[:-1]
    other = two[order][1:] != two[order][:-1]
    if (same & other).any():  # shingles that only their second hash tells apart
        order = np.lexsort((two, one, owner))
        same = (one[order][1:] == one[order][:-1]) & (owner[1:] == owner[:-1])
        other = two[order][1:] != two[order][:-1]
    kept = np.flatnonzero(np.r_[True, ~same | other]) if len(order) else order
    order, size = order[kept], np.bincount(owner[kept], minlength=len(count))
    return one[order], two[order], np.r_[0, np.cumsum(size)].astype(np.int64)


def _sign(forests: list[int]):
    """doc_id, key, n_shingles, the two halves of the set's digest, and the minhash values (big-endian, so that bytes sort alike), for
    each of the forests' hash functions."""
    seeds = [mix(np.arange(1, 2 * CODES + 1, dtype=np.uint64) + np.uint64(f * 2 * CODES)) | np.uint64(1) for f in forests]

    def run(batches):
        for batch in small_batches(batches):
            sets, second, off = shingle_sets(batch.column(2))
            n = np.diff(off)
            full = np.flatnonzero(n)
            at = off[:-1][full]
            raw, more = memoryview(sets.tobytes()), memoryview(second.tobytes())
            each = [hashlib.blake2b(b"".join([raw[8 * i : 8 * j], more[8 * i : 8 * j]]), digest_size=16).digest() for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            one, two = np.frombuffer(b"".join(each), np.int64).reshape(-1, 2).T
            for forest, seed in zip(forests, seeds, strict=True):
                codes = np.zeros((len(n), CODES), ">u2")
                for k in range(CODES if len(full) else 0):
                    least = np.minimum.reduceat((sets ^ seed[k]) * seed[CODES + k], at)
                    codes[full, k] = mix(least) >> np.uint64(48)
                columns = [batch.column(0), batch.column(1), pa.array(np.full(len(n), forest, np.int32)), pa.array(n, pa.int64()), pa.array(np.ascontiguousarray(one)), pa.array(np.ascontiguousarray(two)), pa.array([r.tobytes() for r in codes], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "forest", "n_shingles", "set_1", "set_2", "codes"])

    return run


def signatures(docs: DataFrame, forests: list[int]) -> DataFrame:
    """Signed rows of docs(doc_id, key, text): one per row and forest."""
    return docs.select("doc_id", "key", "text").mapInArrow(_sign(forests), "doc_id long, key long, forest int, n_shingles long, set_1 long, set_2 long, codes binary")


def certainty(depth: int, percent: int) -> float:
    """What an order adds to a class' certainty: - log of the chance that it parts a pair at the threshold before `depth`."""
    return -math.log1p(-((percent / 100) ** depth))


def orders_for(percent: int) -> int:
    """Orders of a forest: enough for MISS, with some to spare, where no region is split."""
    return math.ceil(-1.2 * math.log(MISS) / certainty(DEPTHS[0], percent))


def _placed(classes: DataFrame, orders: int) -> DataFrame:
    """forest, order, region, id and key: each class once in every order, with the region of its first values."""
    placed = classes.select("forest", "id", "key", "codes", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("order"))
    return placed.select("forest", "order", "id", "key", _region(_label(orders), DEPTHS[0]).alias("region"))


def _label(orders: int):
    """The values in the sequence of an order."""
    return F.expr(f"substring(concat(codes, codes), order * {2 * max(CODES // orders, 1)} + 1, {2 * CODES})")


def _region(label, depth: int):
    return F.xxhash64("forest", "order", F.substring(label, 1, 2 * depth))


def _met_before(same: np.ndarray, order: np.ndarray, depths: np.ndarray, others: np.ndarray, step: int) -> np.ndarray:
    """Pairs that an earlier order of the forest compares too: they have as many values in common from its place on as both
    rows' depth there. same: equal values, from the pair's own order on; depths: by order, 0 where a row is not compared."""
    twice = np.concatenate([same, same], axis=1)
    first_other = np.where(twice, 2 * CODES, np.arange(2 * CODES))
    first_other = np.minimum.accumulate(first_other[:, ::-1], axis=1)[:, ::-1]
    met, row = np.zeros(len(same), bool), np.arange(len(same))
    for earlier in range(depths.shape[1] - 1):
        at = CODES - (order - earlier) * step
        depth = depths[:, earlier]
        met |= (earlier < order) & (depth > 0) & (depth == others[:, earlier]) & (first_other[row, np.minimum(at, CODES)] - at >= depth)
    return met


def _neighbours(percent: int, window: int, orders: int = 0):
    """Candidates among the rows of a place, which follow each other in the order of their labels; with `orders`, those that
    no earlier order of the forest gives."""
    share = percent / 100
    least = share - 5 * (share * (1 - share) / CODES) ** 0.5

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = 0 if held is None else held.num_rows
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            place, ids, keys, n, component = (np.asarray(table.column(c)) for c in ("place", "id", "key", "n", "component"))
            codes = np.frombuffer(b"".join(table.column("label").to_pylist()), np.uint16).reshape(-1, CODES)
            if orders:
                order, depths = np.asarray(table.column("order")), np.asarray(table.column("depths").combine_chunks().flatten()).reshape(-1, orders)
            found = []
            for gap in range(1, min(window, len(place) - 1) + 1):
                i = np.arange(max(fresh - gap, 0), len(place) - gap)
                i = i[place[i] == place[i + gap]]
                if not len(i):
                    break
                j = i + gap
                ok = (component[i] != component[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
                i, j = i[ok], j[ok]
                if window == 1 and len(i):  # rows of one label follow its first row, not each other
                    fresh_run = np.r_[True, (place[1:] != place[:-1]) | (codes[1:] != codes[:-1]).any(1)]
                    i = np.where(fresh_run[j], i, np.maximum.accumulate(np.where(fresh_run, np.arange(len(place)), 0))[i])
                for part in range(0, len(i), 4096):
                    x, y = i[part : part + 4096], j[part : part + 4096]
                    same = codes[x] == codes[y]
                    alike = np.flatnonzero(same.mean(1) >= least)
                    if orders:
                        a, b = x[alike], y[alike]
                        alike = alike[~_met_before(same[alike], order[a], depths[a], depths[b], max(CODES // orders, 1))]
                    found.append(np.stack([x[alike], y[alike]]))
            x, y = np.concatenate(found, axis=1) if found else np.zeros((2, 0), int)
            swap = (ids[x] > ids[y]) | ((ids[x] == ids[y]) & (keys[x] > keys[y]))
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (ids[x], keys[x], ids[y], keys[y], n[y])], names=["a", "a_key", "b", "b_key", "n_b"])
            cuts = np.flatnonzero(place[1:] != place[:-1])  # only rows of the last place can meet rows to come
            keep = max(len(place) - window, int(cuts[-1]) + 1 if len(cuts) else 0)
            held = pa.RecordBatch.from_arrays([c.chunk(0) for c in table.slice(keep).combine_chunks().columns], schema=batch.schema)

    return run


def _confirm(percent: int):
    """Links of texts with their partners, by their shingles as words. A hub's row comes first, then its partners'."""

    def run(batches):
        hub = None
        for batch in small_batches(batches):
            table = pa.Table.from_batches([batch] if hub is None else [hub, batch]).combine_chunks()
            is_hub = np.asarray(table.column("is_hub").cast(pa.int8())) > 0
            group = np.cumsum(is_hub)
            words = Words(*raw_text(table.column("text")), fold_case=True)
            runs = run_names(words.names(), SHINGLE)
            starts, count = window_starts(words.first, SHINGLE)  # shorter texts equal only texts of their own class
            names = int(runs.max(initial=0)) + 1
            owner, run = np.divmod(np.unique(np.repeat(np.arange(len(count)), count) * names + runs[starts]), names)
            size, named = np.bincount(owner, minlength=len(count)), group[owner] * names + run
            of_hub = named[is_hub[owner]]  # in order, as its owners are
            at = np.minimum(np.searchsorted(of_hub, named), max(len(of_hub) - 1, 0))
            both = np.bincount(owner[of_hub[at] == named], minlength=len(count)) if len(of_hub) else np.zeros(len(count), int)
            hub_size = np.r_[0, size[is_hub]][group]
            ok = ~is_hub & (both > 0) & (100 * both >= percent * (size + hub_size - both))
            yield pa.RecordBatch.from_arrays([table.column(c).combine_chunks().filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])
            last = np.flatnonzero(is_hub)[-1]
            hub = pa.RecordBatch.from_arrays([c.combine_chunks().slice(int(last), 1) for c in table.columns], schema=batch.schema)

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the candidates, a scratch table that goes. A class with many partners is dealt over several groups."""
    parts = pairs.groupBy("a", "a_key").agg(F.ceil(F.sum("n_b") / SHOWN).cast("int").alias("parts"))
    salted = pairs.join(parts, ["a", "a_key"]).withColumn("part", F.pmod(F.xxhash64("b", "b_key"), F.col("parts")).cast("int"))
    partners = salted.join(texts.select(F.col("id").alias("b"), F.col("key").alias("b_key"), "text"), ["b", "b_key"]).select("a", "a_key", "part", "b", F.lit(False).alias("is_hub"), "text")
    hubs = parts.join(texts.select(F.col("id").alias("a"), F.col("key").alias("a_key"), "text"), ["a", "a_key"])
    hubs = hubs.select("a", "a_key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("b"), F.lit(True).alias("is_hub"), "text")
    rows = hubs.unionByName(partners).repartition("a", "a_key", "part").sortWithinPartitions("a", "a_key", "part", F.desc("is_hub"))
    links = materialise(rows.select("a", "b", "is_hub", "text").mapInArrow(_confirm(percent), "a long, b long"), "links")
    discard(pairs)
    return links


def _first_candidates(classes: DataFrame, orders: int, percent: int) -> DataFrame:
    """Direct neighbours in the first orders. The orders are cut into ranges, so that a large region is no hot key."""
    rows = classes.withColumn("order", F.explode(F.sequence(F.lit(0), F.lit(min(FIRST_ORDERS, orders) - 1)))).withColumn("label", _label(orders))
    rows = rows.select("order", _region("label", DEPTHS[0]).alias("place"), "id", "key", "n", F.col("id").alias("component"), "label")
    return rows.repartitionByRange("order", "label", "id").sortWithinPartitions("order", "label", "id").drop("order").mapInArrow(_neighbours(percent, 1), _PAIR)


def _opened(rows: DataFrame, how: str = "inner") -> DataFrame:
    """The rows of regions of several components, with the region's number of rows and its smallest id; "left" keeps the others, with
    nulls. A row is met once, and nothing but an aggregate of its region meets it."""
    stats = (F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("hub"), F.min_by("key", "id").alias("hub_key"))
    return rows.join(rows.groupBy("region").agg(*stats).where("low <> high").drop("low", "high"), "region", how)


def _deeper(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chain of wide regions of several components that each row lies in, named by the deepest of them, its leaf (a
    scratch table), and where the row ends, if its region is to be compared: the first depth at which it is small enough,
    unless one of one component comes first. Only rows whose region is still wide and open go on to the next depth."""
    carried, tables = [*_ROW, "n", "component", "label"], []
    left = wide.select(*carried, F.array(F.struct(F.lit(DEPTHS[0]).alias("depth"), "region")).alias("chain"))
    for depth in DEPTHS[1:]:
        each = materialise(_opened(left.withColumn("region", _region("label", depth)), "left").withColumn("depth", F.lit(depth)), "depths")
        tables.append(each)
        further = each.where(f"size > {WIDE}")
        if depth == CODES or not further.limit(1).count():
            break
        left = further.select(*carried, F.concat("chain", F.array(F.struct("depth", "region"))).alias("chain"))
    last = reduce(DataFrame.unionByName, tables).where(f"coalesce(size, 0) <= {WIDE} or depth = {CODES}")  # each row once
    ended = materialise(last.where("size is not null").drop("chain"), "regions")
    chains = materialise(last.select(*_ROW, F.element_at("chain", -1)["region"].alias("leaf"), "chain"), "chains")
    for table in tables:
        discard(table)
    return chains, ended


def _forest(members: DataFrame, classes: DataFrame, orders: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Candidates in different components, and the chain of wide regions of each row that lies in any (None: no region is
    wide; else a scratch table). members(forest, order, region, id, key), classes(forest, id, key, n, codes, component)."""
    rows = members.join(classes.select("forest", "id", "key", "component"), ["forest", "id", "key"])
    opened = _opened(rows).join(classes.select("forest", "id", "key", "n", "codes"), ["forest", "id", "key"])
    opened = materialise(opened.withColumn("label", _label(orders)).drop("codes"), "regions")
    wide, columns = opened.where(f"size > {WIDE}"), [*_ROW, "n", "component", "label", "region", "depth"]
    compared, chains, ended = opened.where(f"size <= {WIDE}").withColumn("depth", F.lit(DEPTHS[0])).select(*columns), None, None
    if wide.limit(1).count():
        chains, ended = _deeper(wide)
        compared = compared.unionByName(ended.where(f"size <= {WIDE}").select(*columns))
    compared = materialise(compared, "compared")
    at = F.map_from_entries(F.collect_list(F.struct("order", "depth")))
    depths = F.transform(F.sequence(F.lit(0), F.lit(orders - 1)), lambda o: F.coalesce(F.element_at("at", o), F.lit(0)))
    depths = compared.groupBy("forest", "id", "key").agg(at.alias("at")).select("forest", "id", "key", depths.alias("depths"))
    pairs = compared.join(depths, ["forest", "id", "key"]).select(F.col("region").alias("place"), "order", "label", "id", "key", "n", "component", "depths")
    pairs = pairs.repartition("place").sortWithinPartitions("place", "label", "id", "key").mapInArrow(_neighbours(percent, WIDE, orders), _PAIR)
    if ended is not None:
        # classes that have every value in common: all of them with the smallest
        equal = ended.where(f"size > {WIDE} and id <> hub")
        pairs = pairs.unionByName(equal.select(F.col("hub").alias("a"), F.col("hub_key").alias("a_key"), F.col("id").alias("b"), F.col("key").alias("b_key"), F.col("n").alias("n_b")))
    pairs = materialise(pairs.distinct(), "pairs")
    for table in (opened, compared, ended):
        if table is not None:
            discard(table)
    return pairs, chains


def _lost(chains: DataFrame, with_component, percent: int) -> DataFrame:
    """The rows of the chains (a scratch table) that lie in a region that still has several components, with what their
    class' certainty loses to such regions: the certainty that it would have at a region's depth, less that at the next.

    Regions are nested, so the components are gathered by leaf, and by region from the leaves, which are few: each has
    more than WIDE rows. A row is joined with its class' component and with its leaf, whatever the depths."""
    leaves = with_component(chains).groupBy("leaf").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.first("chain").alias("chain"))
    leaves = materialise(leaves, "leaves")  # read twice
    each = leaves.select("leaf", "low", "high", F.explode("chain").alias("at")).select("leaf", "low", "high", "at.*")
    several = each.groupBy("depth", "region").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least <> most").select("depth", "region")
    step = F.create_map(*(x for d, after in pairwise(DEPTHS) for x in (F.lit(d), F.lit(certainty(d, percent) - certainty(after, percent)))))
    loss = each.join(several, ["depth", "region"]).groupBy("leaf").agg(F.sum(step[F.col("depth")]).alias("loss"))
    left = materialise(chains.select(*_ROW, "leaf", "chain").join(loss, "leaf"), "chains")
    discard(leaves)
    return left


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept, for every row of docs.

    Links join sets with 100 * intersection >= percent * union.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    signed = materialise(signatures(rows, [0]).drop("forest"), "signatures")
    named = signed.where("n_shingles > 0 and doc_id is not null")
    # equal sets have equal codes
    classes = named.groupBy("set_1", "set_2", "n_shingles", "codes").agg(F.min("doc_id").alias("id"), F.min_by("key", "doc_id").alias("key"))
    classes = materialise(classes.withColumnRenamed("n_shingles", "n").withColumn("forest", F.lit(0)), "classes")

    # a document of several rows joins their classes
    spread = named.groupBy("doc_id").agg(F.min("set_1").alias("s"), F.max("set_1").alias("t"), F.min("set_2").alias("u"), F.max("set_2").alias("v")).where("s <> t or u <> v")
    own = named.join(spread.select("doc_id"), "doc_id", "left_semi").select("doc_id", "set_1", "set_2", F.col("n_shingles").alias("n"))
    own = own.join(classes.select("id", "set_1", "set_2", "n"), ["set_1", "set_2", "n"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    own = materialise(own.where("a <> b").distinct(), "links")

    orders = orders_for(percent)
    placed = _placed(classes, orders)
    shared = placed.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("region")
    members = materialise(placed.join(shared, "region"), "members")

    # whole texts of the classes that have a neighbour: a small part of the input, moved once
    near = members.select("id", "key").distinct()
    texts = rows.withColumnRenamed("doc_id", "id").join(near, ["id", "key"], "left_semi")
    texts = materialise(texts.dropDuplicates(["id", "key"]), "texts")
    first = _confirmed(materialise(_first_candidates(classes, orders, percent).distinct(), "pairs"), texts, percent)
    labels = components(own.unionByName(first))
    for table in (own, first):
        discard(table)

    def with_component(table: DataFrame) -> DataFrame:
        return table.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))

    active, grown, more = classes.select("forest", "id", "key", "n", "codes"), 0, 1
    full, sure, have, held = orders * certainty(DEPTHS[0], percent), -math.log(MISS), None, []
    while True:
        pairs, chains = _forest(members, with_component(active), orders, percent)
        links = _confirmed(pairs, texts, percent)
        labels = joined_components(labels, links)  # whole, before any region is called open
        grown += more
        for table in (links, members, *([active] if have is not None else [])):
            discard(table)
        if chains is None:
            break  # every class that took part has been compared with all its neighbours
        # earlier forests' regions count anew: components that have grown together since leave less to miss; what has
        # become one component stays so, and is left out from then on
        held.append(chains)
        left = _lost(reduce(DataFrame.unionByName, (t.select(*_ROW, "leaf", "chain") for t in held)), with_component, percent)
        for table in held:
            discard(table)
        held, lost = [left], left.groupBy("id", "key").agg(F.sum("loss").alias("lost"))
        certain = F.lit(grown * full) - F.coalesce("lost", F.lit(0.0))
        fresh = lost if have is None else have.select("id", "key").join(lost, ["id", "key"], "left")
        fresh = materialise(fresh.select("id", "key", certain.alias("have")).where(F.col("have") < sure), "open")
        if have is not None:
            discard(have)
        have, least = fresh, fresh.agg(F.min("have")).first()[0]
        if least is None:
            break
        # as many further forests at once as the least certain class needs at its pace, but no more than there are: each
        # completes components, which leaves less to do
        more = min(max(math.ceil((sure - least) * grown / max(least, 1e-9)), 1), grown, AT_ONCE)
        again = signatures(texts.join(have, ["id", "key"], "left_semi").withColumnRenamed("id", "doc_id"), list(range(grown, grown + more)))
        active = materialise(again.select("forest", F.col("doc_id").alias("id"), "key", F.col("n_shingles").alias("n"), "codes"), "signatures")
        members = materialise(_placed(active, orders), "members")
    for table in (texts, *held):
        discard(table)

    # classes, then rows; a class with very many rows is a skewed join that Spark splits
    final = with_component(classes).select("set_1", "set_2", "n", "component")
    joined = signed.join(final, (signed.set_1 == final.set_1) & (signed.set_2 == final.set_2) & (signed.n_shingles == final.n), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), 85)
