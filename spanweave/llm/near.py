"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Documents with equal shingle sets are one class and move as one row.  Each of
``TREES`` trees sorts the classes by its own run of signature values; classes
that share a tree's first ``DEPTH`` values are a bucket.

1. In each sorted order every class meets the neighbour with the longest common
   prefix; dense buckets are split by deeper values first (and, where whole
   prefixes are equal, dealt out, each part tied to the bucket's least class).
   The best candidates are confirmed and joined to components, so that a large
   group collapses with a number of pairs that is linear in its size.
2. What then shares a bucket without sharing a component is compared in full,
   in blocks of bounded size: first by signature, then what may be linked by its
   full sets, which come to the block once per document and not once per pair.  No
   cap on partners, no pairs within a component.

A link of similarity 0.75 shares at least one bucket with probability
1 - (1 - 0.75**3)**20 > 0.99998.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from .components import connected_components
from .staging import broadcast_if_small, staged
from .text import WordHash, arrow_map, as_bytes, carried, mixed, restored, shingles, space_words

#: Words of a shingle, and the similarity of a link in percent.
SHINGLE, PERCENT = 5, 75
#: Trees of the forest, values per tree and those that make a bucket.
TREES, VALUES, DEPTH = 20, 7, 3
#: Share of equal signature values below which a pair is not confirmed: five and a half standard deviations under 0.75.
LEAST_EQUAL = 0.55
#: Bucket sizes from which prefixes deepen and equal ones are dealt out; members and queries of a comparison block.
DENSE, DEAL, BLOCK, QUERIES = 256, 4096, 512, 4096
#: Candidates of a class that are confirmed in the first phase; the second phase takes all others.
BEST = 2

MULTIPLIERS = mixed(np.arange(1, TREES * VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signature(hashes: np.ndarray) -> bytes:
    """16 bits of the least value of each of the signature's hash functions."""
    least = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 256):
        np.minimum(least, (hashes[at : at + 256, None] * MULTIPLIERS).min(axis=0), out=least)
    return (mixed(least) >> np.uint64(48)).astype(">u2").tobytes()


def shingle_table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, and for a non-empty set ``digest`` and ``sig``."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def start():
        cache = WordHash()

        def step(batch):
            n, digest, sig = [], [], []
            for raw in as_bytes(batch.column(1)):
                found = shingles(cache.array(space_words(raw)), SHINGLE)
                n.append(len(found))
                digest.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sig.append(signature(found) if len(found) else None)
            return {"doc_id": batch.column(0), "n_shingles": n, "digest": digest, "sig": sig}

        return step

    return arrow_map(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), start, f"doc_id {kind}, n_shingles long, digest binary, sig binary")


def shingle_sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """``rep`` and ``shingles`` (sorted 64-bit hashes) of the documents whose id is in ``wanted(rep)``."""
    kind = docs.schema[doc_id].dataType.simpleString()
    chosen = docs.select(F.col(doc_id).alias("rep"), F.col(text).alias("text")).join(broadcast_if_small(wanted), "rep", "left_semi")

    def start():
        cache = WordHash()

        def step(batch):
            sets = [shingles(cache.array(space_words(raw)), SHINGLE).tobytes() for raw in as_bytes(batch.column(1))]
            return {"rep": batch.column(0), "shingles": sets}

        return step

    return arrow_map(chosen, start, f"rep {kind}, shingles binary")


def buckets(classes: DataFrame) -> DataFrame:
    """Classes that share a bucket with another: ``key``, ``rep``, ``deep`` (the tree's further values), ``n`` and ``low`` of the bucket.

    Sizes are written first, so that the join with them is one of two plain tables and Spark can split a large bucket.
    """
    width = 2 * VALUES
    rows = classes.select("rep", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(
        F.xxhash64("tree", F.substring("sig", F.col("tree") * width + 1, F.lit(2 * DEPTH))).alias("key"),
        "tree",
        "rep",
        F.substring("sig", F.col("tree") * width + 1 + 2 * DEPTH, F.lit(width - 2 * DEPTH)).alias("deep"),
    )
    sizes = staged(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("low")).where("n > 1"))
    return rows.join(sizes, "key")


def neighbours(members: DataFrame) -> DataFrame:
    """Candidate pairs (a > b) of the sorted orders: the neighbour with the longest common prefix."""
    region = F.when(F.col("n") > DENSE, F.substring("deep", 1, 4)).otherwise(F.lit(b""))
    deal = F.when(F.col("n") > DEAL, F.pmod(F.xxhash64("key", "rep"), F.ceil(F.col("n") / DEAL))).otherwise(F.lit(0).cast("long"))
    order = Window.partitionBy("key", "region", "deal").orderBy("deep", "rep")
    met = members.withColumns({"region": region, "deal": deal}).select("rep", F.coalesce(F.lag("rep").over(order), "low").alias("other"))
    return met.where("rep <> other").select(F.greatest("rep", "other").alias("a"), F.least("rep", "other").alias("b")).distinct()


def equal_share(one: str, other: str, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b, sig and size of both) with ``equal``, the share of equal signature values."""
    fields = pairs.select("a", "b").schema

    def start():
        def step(batch):
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
            return {"a": batch.column(0), "b": batch.column(1), "equal": (x == y).mean(axis=1) if batch.num_rows else []}

        return step

    kind = fields["a"].dataType.simpleString()
    return arrow_map(pairs.select("a", "b", one, other), start, f"a {kind}, b {kind}, equal double")


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose set sizes and signatures allow a link, with ``equal``."""
    of = lambda side: classes.select(F.col("rep").alias(side), F.col("sig").alias(f"sig_{side}"), F.col("n_shingles").alias(f"n_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    fits = both.where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
    return equal_share("sig_a", "sig_b", fits).where(F.col("equal") >= LEAST_EQUAL)


def confirmed(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have the similarity of a link."""
    pairs = staged(pairs)
    wanted = staged(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    sets = staged(shingle_sets(docs, doc_id, text, wanted))
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
    kind = docs.schema[doc_id].dataType.simpleString()

    def start():
        def step(batch):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                keep.append(similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
            chosen = batch.filter(pa.array(keep, pa.bool_()))
            return {"a": chosen.column(0), "b": chosen.column(1)}

        return step

    return arrow_map(both.select("a", "b", "x", "y"), start, f"a {kind}, b {kind}").distinct()


def apart(members: DataFrame, component_of: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Links (a > b) between classes that share a bucket but no component, each bucket compared in blocks of bounded size.

    The classes outside a bucket's largest component ask, all its classes answer.
    """
    placed = members.select("key", "tree", "rep", "n").join(component_of.withColumnRenamed("node", "rep"), "rep", "left").select("key", "tree", "rep", "n", F.coalesce("component", "rep").alias("component"))
    shares = placed.groupBy("key", "component").agg(F.count("*").alias("m"))
    main = staged(shares.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("parts"), F.max("m").alias("most")).where("parts > 1"))
    rows = placed.join(main, "key").withColumns(
        {
            "query": F.col("component") != F.col("main"),
            "blocks": F.ceil(F.col("n") / BLOCK),
            "parts": F.ceil((F.col("n") - F.col("most")) / QUERIES),
        }
    )
    dealt = F.xxhash64("rep")
    each = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    as_member = rows.select("key", "tree", "rep", "component", "query", F.lit(False).alias("asks"), F.pmod(dealt, F.col("blocks")).alias("block"), F.explode(each("parts")).alias("part"))
    as_query = rows.where("query").select("key", "tree", "rep", "component", "query", F.lit(True).alias("asks"), F.explode(each("blocks")).alias("block"), F.pmod(dealt, F.col("parts")).alias("part"))
    kind = classes.schema["rep"].dataType.simpleString()
    told = as_member.unionByName(as_query)
    columns = ["key", "block", "part", "tree", "rep", "component", "query", "asks"]

    def in_blocks(more: DataFrame, *extra: str) -> DataFrame:
        both = more.join(classes.select("rep", "sig", "n_shingles"), "rep").select(*columns, "n_shingles", "sig", *extra)
        return both.repartition(F.col("key"), F.col("block"), F.col("part")).sortWithinPartitions("key", "block", "part")

    def likely_rows(batches):
        for group in grouped(batches, 3):
            chosen = {x for q, near in across(group) for x in (q, *near)}
            if chosen:
                yield from group.select(columns).take(pa.array(sorted(chosen))).combine_chunks().to_batches()

    arrow = pa.schema([("a", id_type(kind)), ("b", id_type(kind))])

    def linked(batches):
        for group in grouped(batches, 3):
            found = links(group)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([max(x) for x in found], arrow[0].type), pa.array([min(x) for x in found], arrow[1].type)], schema=arrow)

    first = in_blocks(told)
    asked = staged(first.mapInArrow(likely_rows, first.select(*columns).schema))
    sets = staged(shingle_sets(docs, doc_id, text, staged(asked.select("rep").distinct())))
    return in_blocks(asked.join(sets, "rep"), "shingles").mapInArrow(linked, f"a {kind}, b {kind}").distinct()


def id_type(kind: str) -> pa.DataType:
    return to_arrow_schema(_parse_datatype_string(f"id {kind}"))[0].type


def grouped(batches, n: int):
    """Runs of equal values in the first ``n`` columns of sorted batches, each as one record batch table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(keys[:, a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def across(group: pa.Table):
    """For each asking row of a block, the rows of other components that may be linked with it and share no bucket of an earlier tree, most alike first."""
    tree, rep, component, query, asks, n, sig = (group.column(i).to_pylist() for i in range(3, 10))
    member = np.array([i for i, x in enumerate(asks) if not x], np.int64)
    if not len(member):
        return
    sigs = np.frombuffer(b"".join([sig[i] for i in member]), np.uint16).reshape(len(member), -1)
    sizes, of_query = np.array([n[i] for i in member], np.int64), np.array([query[i] for i in member])
    reps, components = np.array([rep[i] for i in member]), np.array([component[i] for i in member])
    for q in (i for i, x in enumerate(asks) if x):
        # Of two rows that ask each other one is enough.
        fits = (100 * np.minimum(sizes, n[q]) >= PERCENT * np.maximum(sizes, n[q])) & (components != component[q]) & (~of_query | (reps > rep[q]))
        fits = np.flatnonzero(fits)
        if not len(fits):
            continue
        equal = sigs[fits] == np.frombuffer(sig[q], np.uint16)
        share = equal.mean(axis=1)
        first = equal.reshape(len(fits), TREES, VALUES)[:, :, :DEPTH].all(axis=2).argmax(axis=1) == tree[q]
        near = np.flatnonzero((share >= LEAST_EQUAL) & first)
        if len(near):
            yield q, member[fits[near[np.argsort(-share[near], kind="stable")]]].tolist()


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, as sorted distinct hashes, have the similarity of a link."""
    joined = np.sort(np.concatenate((x, y)), kind="stable")
    shared = int((joined[1:] == joined[:-1]).sum())
    return 100 * shared >= PERCENT * (len(joined) - shared)


def links(group: pa.Table) -> list[tuple]:
    """Confirmed links of a block; a row that has one with a component needs no other with it."""
    rep, component = group.column(4).to_pylist(), group.column(5).to_pylist()
    sets: dict[int, np.ndarray] = {}
    at = lambda i: sets[i] if i in sets else sets.setdefault(i, np.frombuffer(group.column(10)[i].as_buffer(), np.uint64))
    found = []
    for q, near in across(group):
        done = set()
        for m in near:
            if component[m] not in done and similar(at(q), at(m)):
                done.add(component[m])
                found.append((rep[q], rep[m]))
    return found


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` (the least id reachable over links, itself
    included) and ``kept`` (whether it is that document).

    Words are runs without ASCII white space, A-Z lower-cased; a set has the distinct 5-word shingles, or
    the whole sequence of a shorter text.  Null and empty texts have empty sets and no links.  Rows that
    share an id are one document.  A row without an id has no component and is kept.  Ids are of any type that has an order.
    """
    table = staged(shingle_table(docs, doc_id, text))
    classes = staged(table.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")))
    members = staged(buckets(classes))
    close = likely(neighbours(members), classes)
    best = close.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("equal"), "b"))).where(F.col("place") <= BEST).select("a", "b")
    first = staged(confirmed(best, docs, doc_id, text))
    more = staged(apart(members, connected_components(first), classes, docs, doc_id, text))
    same = table.where("digest is not null and doc_id is not null").select("doc_id", "digest").join(classes.select("digest", "rep"), "digest").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    linked = connected_components(first.unionByName(more))
    # Copies take the component of their class; only ids with rows of several texts tie classes together beyond that.
    twice = table.where("digest is not null and doc_id is not null").groupBy("doc_id").agg(F.count_distinct("digest").alias("texts")).where("texts > 1").select("doc_id")
    if not twice.isEmpty():
        linked = connected_components(first.unionByName(more).unionByName(same))
    by_class = classes.select("digest", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    named = table.join(by_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without the documents that are near-duplicates of one with a lesser id."""
    held, own = carried(docs)
    dropped = staged(near_groups(docs.select(doc_id, text), doc_id, text).where("not kept").select(F.col("doc_id").alias("__id")).distinct())
    return restored(held.join(broadcast_if_small(dropped), F.col(own[doc_id]) == F.col("__id"), "left_anti"), docs)
