"""Set-similarity join of word n-grams by prefixes of token combinations.

Tokens are the hashes of a document's distinct n-grams, in one order for all documents: by frequency, then by hash.  Sets of
similarity ``percent`` of which one has n tokens differ in at most n - ceil(percent * n / 100) of them, so a prefix that they would
have to differ in more often is one in which they share something:

* a rare token counts as itself: two prefixes of r rare tokens that share none differ in r;
* frequent tokens are dealt by hash into groups, and one index key is made of each k tokens of a group (k = 2, for very frequent
  ones 3): of m tokens of a group, sets that share no such combination differ in m - k + 1 at least.

The prefix grows until these numbers add up to one more than the allowed difference.  Groups are as many as the size of the set asks for:
sizes have levels, and a set near the border of two has the keys of both.  Equal keys are candidates, and none are lost:
frequencies only order and class the tokens, and any values of them give the same links.

Documents with equal sets are one class and move as one row.  Each key's classes first meet the least one; the links found there make
components, so a large group of near copies takes pairs in proportion to its size.  Classes of a key in different components are then
compared in blocks.  Before full sets are read, their sizes and parity bits (which each differing token turns once, so that
unequal bits are a lower bound of the difference) must allow a link.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .near import grouped, id_type
from .staging import broadcast_if_small, staged
from .text import SLICE_BYTES, STEP, WordHash, arrow_map, as_bytes, mixed, release, shingles, sliced, small_batches, space_words

#: Words of a token, and the similarity of a link in percent; the least that levels and groups are right for.
SHINGLE, PERCENT, LEAST_PERCENT = 4, 85, 75
#: Cells of the frequency sketch and of the pieces in which it is summed, and how many tasks' pieces are summed first.
CELLS, PIECE, SALTS = 1 << 20, 1 << 14, 16
#: How often a cell of the sketch is above its usual count where pairs, and where triples of tokens are indexed.
PAIRS_FROM, TRIPLES_FROM = 64, 8192
#: Least set size of the first level with groups, and 64-bit words of the parity bits.
LEVEL, PARITY = 16, 16
#: Classes and asking classes of a comparison block.
BLOCK, QUERIES = 512, 4096


def frequencies(docs: DataFrame, text: str, shingle: int) -> np.ndarray:
    """In how many documents the tokens of each cell are, all documents counted; the cells, 8 MB, come to the driver."""
    small_batches(docs.sparkSession)

    def count(batches):
        cache, cells = WordHash(), np.zeros(CELLS, np.int64)
        for batch in batches:
            for part in sliced(batch, SLICE_BYTES):
                found = [shingles(cache.array(space_words(raw)), shingle) for raw in as_bytes(part.column(0))]
                cells += np.bincount((np.concatenate(found) // np.uint64((1 << 64) // CELLS)).astype(np.int64), minlength=CELLS)
        pieces = [(k, x) for k, x in enumerate(cells.reshape(-1, PIECE)) if x.any()]
        yield pieced(pieces, TaskContext.get().partitionId() % SALTS)
        release()

    def add(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for key, salt, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x = np.frombuffer(raw, f"u{len(raw) // PIECE}").astype(np.int64)
                total[key, salt] = total[key, salt] + x if (key, salt) in total else x
        for (key, salt), x in total.items():
            yield pieced([(key, x)], salt)

    kind = "piece int, salt int, counts binary"
    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, kind)
    salted = counted.repartition("piece", "salt").mapInArrow(add, kind).withColumn("salt", F.lit(0))
    out = np.zeros((CELLS // PIECE, PIECE), np.int64)
    for r in salted.repartition("piece").mapInArrow(add, kind).collect():
        out[r.piece] = np.frombuffer(r.counts, f"u{len(r.counts) // PIECE}")
    return out.ravel()


def pieced(pieces: list[tuple[int, np.ndarray]], salt: int) -> pa.RecordBatch:
    """Pieces of counts as rows, each in the least type that holds it."""
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in pieces], pa.int32()), pa.array([salt] * len(pieces), pa.int32()), pa.array([x.astype(np.min_scalar_type(int(x.max()))).tobytes() for _, x in pieces], pa.binary())], names=["piece", "salt", "counts"])


class Index:
    """Keys of sets: ``counts`` are the frequencies by cell."""

    def __init__(self, counts: np.ndarray, percent: int):
        if not LEAST_PERCENT <= percent <= 100:
            raise ValueError(f"percent is from {LEAST_PERCENT} to 100")
        self.percent = percent
        self.counts = np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32)
        # What other tokens of a cell add, with four standard deviations.
        usual = float(np.median(counts))
        usual += 4 * usual**0.5
        self.bounds = (usual + PAIRS_FROM, usual + TRIPLES_FROM)

    def levels(self, n: int) -> list[int]:
        """Least sizes of the levels of a set: its own and, where a larger set that it may link with is on it, the next."""
        own = LEVEL
        while own <= n:
            own *= 2
        return [own // 2] if 100 * n < self.percent * own else [own // 2, own]

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        """The keys of a set of sorted distinct tokens, one of which any set that it links with, but doesn't equal, shares."""
        n = len(tokens)
        if 100 * n < self.percent * (n + 1):
            return tokens[:0]
        least = n - (-(-self.percent * n // 100)) + 1
        count = self.counts[(tokens // np.uint64((1 << 64) // CELLS)).astype(np.int64)]
        order = np.lexsort((tokens, count))
        tokens, count = tokens[order], count[order]
        rare = int(np.searchsorted(count, self.bounds[0], "right"))
        if rare >= least:
            return mixed(tokens[:least])
        found = [mixed(tokens[:rare])]
        for level in self.levels(n):
            if level < LEVEL:
                found.append(mixed(tokens[rare:least]))
            else:
                found.append(self.combined(tokens[rare:], np.where(count[rare:] > self.bounds[1], 3, 2), least - rare, level))
        return np.unique(np.concatenate(found))

    def combined(self, tokens: np.ndarray, k: np.ndarray, least: int, level: int) -> np.ndarray:
        """Combinations of a level's groups; the groups take half the level's least size at most, which leaves enough for ``least``."""
        groups = np.where(k == 3, level // 8, level // 4).astype(np.uint64)
        group = (mixed(tokens ^ STEP) % groups).astype(np.int64) * 4 + k
        by_group = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.diff(group[by_group], prepend=-1))
        place = np.empty(len(tokens), np.int64)
        place[by_group] = np.arange(len(tokens)) - np.repeat(first, np.diff(first, append=len(tokens)))
        taken = int(np.searchsorted(np.cumsum(place >= k - 1), least)) + 1
        members: dict[int, list[int]] = {}
        for g, x in zip(group[:taken].tolist(), tokens[:taken].tolist(), strict=True):
            members.setdefault(g, []).append(x)
        found = [np.zeros(0, np.uint64)]
        for size in (2, 3):
            rows = [c for g, x in members.items() if g % 4 == size for c in combinations(x, size)]
            if rows:
                key = np.full(len(rows), level, np.uint64)
                for x in np.array(rows, np.uint64).T:
                    key = mixed(key * STEP + x)
                found.append(key)
        return np.concatenate(found)


def parity(tokens: np.ndarray, bits: int | None = None) -> bytes:
    """Of each of so many bits (a power of two; ``64 * PARITY``), whether an odd number of tokens falls on it."""
    bits = bits or 64 * PARITY
    odd = np.bincount((mixed(tokens) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_parity(tokens: np.ndarray) -> bytes | None:
    """As many bits as tokens at least, where the short ones are fewer."""
    return parity(tokens, 1 << (len(tokens) - 1).bit_length()) if len(tokens) > 64 * PARITY else None


def unequal(x: bytes, y: bytes) -> int:
    """Unequal parity bits of two sets; the longer ones are folded to the shorter."""
    x, y = (np.frombuffer(b, np.uint64) for b in (x, y))
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def may_link(size: np.ndarray, other: int, differing: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in so many tokens at least may have the similarity of a link."""
    return (100 * np.minimum(size, other) >= percent * np.maximum(size, other)) & ((100 + percent) * differing <= (100 - percent) * (size + other))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    joined = np.sort(np.concatenate((x, y)), kind="stable")
    shared = int((joined[1:] == joined[:-1]).sum())
    return 100 * shared >= percent * (len(joined) - shared)


def keyed(docs: DataFrame, doc_id: str, text: str, shingle: int, index: Index) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, and for a non-empty set ``digest``, ``bits``, ``wide`` (null for a small set) and ``keys``."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def start():
        cache = WordHash()

        def step(batch):
            n, digest, bits, wide, keys = [], [], [], [], []
            for raw in as_bytes(batch.column(1)):
                found = shingles(cache.array(space_words(raw)), shingle)
                n.append(len(found))
                digest.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                bits.append(parity(found) if len(found) else None)
                wide.append(wide_parity(found))
                keys.append(index.keys(found).view(np.int64) if len(found) else None)
            return {"doc_id": batch.column(0), "n_shingles": n, "digest": digest, "bits": bits, "wide": wide, "keys": keys}

        return step

    return arrow_map(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), start, f"doc_id {kind}, n_shingles long, digest binary, bits binary, wide binary, keys array<long>")


def sets_of(docs: DataFrame, doc_id: str, text: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """``rep`` and ``tokens`` (sorted, as bytes) of the documents whose id is in ``wanted(rep)``."""
    kind = docs.schema[doc_id].dataType.simpleString()
    chosen = docs.select(F.col(doc_id).alias("rep"), F.col(text).alias("text")).join(broadcast_if_small(wanted), "rep", "left_semi")

    def start():
        cache = WordHash()

        def step(batch):
            return {"rep": batch.column(0), "tokens": [shingles(cache.array(space_words(raw)), shingle).tobytes() for raw in as_bytes(batch.column(1))]}

        return step

    return arrow_map(chosen, start, f"rep {kind}, tokens binary")


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and parity bits allow: the short bits first, the wide ones of what these leave."""
    return allowed(staged(allowed(pairs, classes.drop("wide"), "bits", percent)), classes.where("wide is not null"), "wide", percent)


def allowed(pairs: DataFrame, classes: DataFrame, name: str, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and the bits ``name`` allow; pairs with a side that has none stay."""
    bits = classes.select("rep", "n_shingles", name)
    if name == "wide":
        bits = bits.join(broadcast_if_small(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()), "rep", "left_semi")
    of = lambda side: bits.toDF(side, f"n_{side}", f"bits_{side}")
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    kind = classes.schema["rep"].dataType.simpleString()

    def start():
        def step(batch):
            n, m, x, y = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = [None in (p, q) or may_link(np.array([i]), j, np.array([unequal(p, q)]), percent)[0] for i, j, p, q in zip(n, m, x, y, strict=True)]
            chosen = batch.filter(pa.array(keep, pa.bool_()))
            return {"a": chosen.column(0), "b": chosen.column(1)}

        return step

    return arrow_map(both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b"), start, f"a {kind}, b {kind}").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity of a link."""
    pairs = staged(pairs)
    sets = staged(sets_of(docs, doc_id, text, shingle, staged(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())))
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("tokens").alias("y")), "b")
    kind = docs.schema[doc_id].dataType.simpleString()

    def start():
        def step(batch):
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            chosen = batch.filter(pa.array(keep, pa.bool_()))
            return {"a": chosen.column(0), "b": chosen.column(1)}

        return step

    return arrow_map(both.select("a", "b", "x", "y"), start, f"a {kind}, b {kind}").distinct()


COLUMNS = ["key", "block", "part", "rep", "component", "query", "asks"]


def apart(members: DataFrame, component_of: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int) -> DataFrame:
    """Links (a > b) between classes that share a key but no component, besides those with the least class of a key.

    Of a key's classes those outside its largest component ask and all answer, in blocks; a pair is
    compared at the least key that it shares.  Full sets come to a block once per class.
    """
    others = members.where("rep <> low").select("key", "rep").join(component_of.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    others = staged(others)
    shares = others.groupBy("key", "component").agg(F.count("*").alias("m"))
    main = staged(shares.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("n_components"), F.max("m").alias("most"), F.sum("m").alias("n")).where("n_components > 1"))
    rows = others.join(main, "key").withColumns({"query": F.col("component") != F.col("main"), "blocks": F.ceil(F.col("n") / BLOCK), "parts": F.ceil((F.col("n") - F.col("most")) / QUERIES)})
    dealt = F.xxhash64("rep")
    each = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    as_member = rows.select("key", "rep", "component", "query", F.lit(False).alias("asks"), F.pmod(dealt, F.col("blocks")).alias("block"), F.explode(each("parts")).alias("part"))
    as_query = rows.where("query").select("key", "rep", "component", "query", F.lit(True).alias("asks"), F.explode(each("blocks")).alias("block"), F.pmod(dealt, F.col("parts")).alias("part"))
    kind = classes.schema["rep"].dataType.simpleString()
    arrow = pa.schema([("a", id_type(kind)), ("b", id_type(kind))])

    def in_blocks(told: DataFrame, *more: str, tokens: DataFrame | None = None) -> DataFrame:
        """``told`` in blocks, with the columns ``more`` of the classes; only those of classes that are still in question are shuffled."""
        of = classes.select("rep", "n_shingles", "bits", *more)
        both = told.join(of if told is all_told else of.join(broadcast_if_small(told.select("rep").distinct()), "rep", "left_semi"), "rep")
        both = both if tokens is None else both.join(tokens, "rep")
        both = both.select(*COLUMNS, "n_shingles", "bits", *more, *([] if tokens is None else ["tokens"]))
        return both.repartition(F.col("key"), F.col("block"), F.col("part")).sortWithinPartitions("key", "block", "part")

    def likely_rows(batches):
        for group in grouped(batches, 3):
            chosen = {x for q, near in across(group, percent) for x in (q, *near)}
            if chosen:
                yield from group.select(COLUMNS).take(pa.array(sorted(chosen))).combine_chunks().to_batches()

    def narrowed(rows: DataFrame) -> DataFrame:
        return staged(rows.mapInArrow(likely_rows, rows.select(*COLUMNS).schema))

    def linked(batches):
        for group in grouped(batches, 3):
            rep, component = group.column(3).to_pylist(), group.column(4).to_pylist()
            found = []
            for q, near in across(group, percent):
                done = set()
                own = np.frombuffer(group.column(9)[q].as_buffer(), np.uint64)
                for m in near:
                    # One link with a component is enough.
                    if component[m] not in done and similar(own, np.frombuffer(group.column(9)[m].as_buffer(), np.uint64), percent):
                        done.add(component[m])
                        found.append((max(rep[q], rep[m]), min(rep[q], rep[m])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], arrow[i].type) for i in (0, 1)], schema=arrow)

    # What sizes and short parity bits leave takes its wide ones along, what those leave its keys, by which each pair stays at one key, and the rest its full set.
    all_told = as_member.unionByName(as_query).select(*COLUMNS)
    asked = narrowed(in_blocks(all_told))
    asked = narrowed(in_blocks(asked, "wide"))
    asked = narrowed(in_blocks(asked, "keys"))
    sets = staged(sets_of(docs, doc_id, text, shingle, staged(asked.select("rep").distinct())))
    return in_blocks(asked, tokens=sets).mapInArrow(linked, f"a {kind}, b {kind}").distinct()


def across(group: pa.Table, percent: int):
    """For each asking row of a block, the rows of other components that may be linked with it and, where the rows have their keys, share no lesser one."""
    wide, keys = (group.column(c).to_pylist() if c in group.column_names else None for c in ("wide", "keys"))
    key = group.column(0)[0].as_py()
    rep, component, query, asks, n, bits = (group.column(i).to_pylist() for i in range(3, 9))
    member = np.array([i for i, x in enumerate(asks) if not x], np.int64)
    if not len(member):
        return
    parities = np.frombuffer(b"".join([bits[i] for i in member]), np.uint64).reshape(len(member), -1)
    sizes, of_query = np.array([n[i] for i in member], np.int64), np.array([query[i] for i in member])
    reps, components = np.array([rep[i] for i in member]), np.array([component[i] for i in member])
    for q in (i for i, x in enumerate(asks) if x):
        # Of two rows that ask each other one is enough.
        fits = np.flatnonzero((components != component[q]) & (~of_query | (reps > rep[q])))
        if not len(fits):
            continue
        differing = np.bitwise_count(parities[fits] ^ np.frombuffer(bits[q], np.uint64)).sum(axis=1, dtype=np.int64)
        near = member[fits[may_link(sizes[fits], n[q], differing, percent)]].tolist()
        if wide is not None and wide[q]:
            near = [m for m in near if not wide[m] or may_link(np.array([n[m]]), n[q], np.array([unequal(wide[q], wide[m])]), percent)[0]]
        if keys is not None:
            own = set(keys[q])
            near = [m for m in near if min(own.intersection(keys[m]), default=None) == key]
        if near:
            yield q, near


def jaccard_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles`` and ``component_id``, the least id reachable over links, itself included.

    Words are runs without ASCII white space, A-Z lower-cased; a set has the distinct ``shingle``-word sequences, or the whole
    sequence of a shorter text.  Two documents link when 100 times the shared part is at least ``percent`` times the union; all links between different sets
    count (sets are compared by 64-bit hashes of their members).

    Null and empty texts have empty sets and no links.  Rows that share an id are one document, repeated rows one class.  A row without
    an id has no component.  Ids are of any type that has an order.  An empty table gives an empty one.
    Raises ValueError for ``percent`` below 75.
    """
    index = Index(frequencies(docs, text, shingle), percent)
    table = staged(keyed(docs, doc_id, text, shingle, index))
    valid = table.where("digest is not null and doc_id is not null")
    by_row = staged(valid.groupBy("digest", "doc_id").agg(F.count("*").alias("n")))
    by_digest = staged(by_row.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    classes = valid.select(F.col("doc_id").alias("rep"), "digest", "n_shingles", "bits", "wide", "keys").join(broadcast_if_small(by_digest), ["digest", "rep"], "left_semi")
    if not by_row.where("n > 1").isEmpty():
        classes = classes.dropDuplicates(["digest", "rep"])
    classes = staged(classes.drop("digest"))
    rows = classes.select("rep", F.explode("keys").alias("key"))
    # Most keys are of one class: only keys and counts are shuffled for them, and the join is one of two plain tables, whose large keys Spark can split.
    shared = staged(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    found = staged(rows.join(shared, "key"))
    members = staged(found.join(found.groupBy("key").agg(F.min("rep").alias("low")), "key"))
    pairs = members.where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()
    first = staged(confirmed(possible(pairs, classes, percent), docs, doc_id, text, shingle, percent))
    more = staged(apart(members, connected_components(first), classes, docs, doc_id, text, shingle, percent))
    links = first.unionByName(more)
    # Copies take the component of their class; only ids with rows of several texts tie classes together beyond that.
    twice = by_row.groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1")
    if not twice.isEmpty():
        links = links.unionByName(by_row.join(by_digest, "digest").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    linked = connected_components(links)
    by_class = by_digest.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return table.select("doc_id", "n_shingles", "digest").join(by_class, "digest", "left").select("doc_id", "n_shingles", component.alias("component_id"))
