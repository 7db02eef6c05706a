"""Near-duplicate documents: a chosen-path set similarity join and the components of its links.

A document is the set of its five-word shingles, all of them. Equal sets are one class and are joined as one. Each
class has a signature of ``COORDINATES`` minwise values. Independent trees branch the classes: a node chooses some
coordinates by its own hash, and a class goes to the child named by its minwise value there, so similar sets stay
together and others part. Nodes of at most ``LEAF`` classes are compared exhaustively by signature and pass on a
maximum spanning forest of their possible links: fewer links than classes, however many pairs there are.

A larger node is compared in blocks, which about ``PIVOTS`` of its classes visit all: so a large group of copies is
linked in time proportional to its size, and does not branch. The classes that are not linked with it so meet every
block; only if these are more than ``LEAF`` the node branches, until it is small or stops shrinking, which only sets that
are alike do. Then all pairs of its blocks are compared.

What possible links connect is a cluster. The first ``FIRST_ROOTS`` roots go ahead; a node of the others is left out if
all its classes are in one cluster already, as those of a large group of copies are. A class is in one cluster only, and
its full text goes there once. Within a cluster all pairs of full sets are compared, a large cluster block against
block, and every member leaves with its component and its links.

Chance that a pair of similarity 0.75 is missed: below 1e-7 by the trees (``TREES`` times ``ROOT_BRANCHES`` chosen
coordinates), below 1e-5 by the signature test. Higher similarities are missed less.
"""

from __future__ import annotations

import hashlib
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from hitlens.llm.common import shuffle_partitions, text_of
from hitlens.llm.grouping import components, groups, narrowed, stars
from hitlens.session import land

SHINGLE_WORDS = 5
LINK_PERCENT = 75
COORDINATES = 64
POSSIBLE = 30  # of the coordinates equal; a pair of similarity 0.75 has 48 on average
TREES, ROOT_BRANCHES, BRANCHES = 8, 2, 2
FIRST_ROOTS = 4
LEAF, DEPTH, SHRINK = 1024, 5, 0.8
PIVOTS = 16
# Classes, and shingles, of a block in a comparison.
BLOCK, BLOCK_SHINGLES = 1024, 2**21
COLUMNS = 4096
# Links that a task makes one set of stars of.
LINKS = 100_000

_rng = np.random.default_rng(20240229)
_word_steps = _rng.integers(1, 2**63, SHINGLE_WORDS, dtype=np.uint64) * 2 + 1
_coordinate_steps = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) * 2 + 1
_coordinate_shifts = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


def shingles(raw: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a UTF-8 text.

    ``bytes.lower`` and ``bytes.split`` know ASCII only: A-Z, and the six white space characters meant here.
    """
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE_WORDS, len(words))
    count = len(words) - width + 1
    total = np.full(count, width, np.uint64)
    for k in range(width):
        total += hashes[k : k + count] * _word_steps[k]
    return np.unique(mixed(total))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of minwise values (uint32) per non-empty set."""
    starts = np.cumsum([0, *(len(one) for one in sets[:-1])])
    values = np.concatenate(sets)
    found = np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        hashed = (values ^ _coordinate_shifts[k]) * _coordinate_steps[k] >> np.uint64(32)
        found[:, k] = np.minimum.reduceat(hashed, starts)
    return found


SET_SCHEMA = "doc_id long, n_shingles long, digest binary, signature binary"
SET_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())]
)


def _sets(batches):
    def rows(ids, sets):
        full = [one for one in sets if len(one)]
        made = iter(signatures(full)) if full else iter(())
        columns = [
            ids,
            [len(one) for one in sets],
            [hashlib.blake2b(one, digest_size=16).digest() if len(one) else None for one in sets],
            [next(made).tobytes() if len(one) else None for one in sets],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SET_ARROW)], schema=SET_ARROW)

    for batch in batches:
        ids, sets, size = [], [], 0
        for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(doc_id)
            sets.append(shingles(raw.as_py()))
            size += len(sets[-1])
            if size > 2**18:
                yield rows(ids, sets)
                ids, sets, size = [], [], 0
        if ids:
            yield rows(ids, sets)


def _raw(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("raw"))


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest, signature of every row; no words: an empty set without digest."""
    return _raw(docs).mapInArrow(_sets, SET_SCHEMA)


# Branching


NODE_SCHEMA = "node long, doc_id long, label long, above long"
NODE_ARROW = pa.schema([(name, pa.int64()) for name in ("node", "doc_id", "label", "above")])


def children(nodes: np.ndarray, signature: np.ndarray, branches: int) -> np.ndarray:
    """Children (one row per node) that a signature goes to: distinct coordinates chosen by each node's hash."""
    chosen = mixed(nodes ^ np.uint64(0x5851F42D4C957F2D))
    first, step = chosen & np.uint64(COORDINATES - 1), (chosen >> np.uint64(32)) & np.uint64(COORDINATES - 1) | np.uint64(1)
    picks = (first[:, None] + step[:, None] * np.arange(branches, dtype=np.uint64)) % np.uint64(COORDINATES)
    values = signature[picks.astype(np.int64)].astype(np.uint64)
    return mixed(nodes[:, None] + (values << np.uint64(8)) + picks + np.uint64(1))


def _roots(first: int, last: int, batches):
    # A root takes its own coordinates, so together the trees use as many different ones as they can.
    tree = np.repeat(np.arange(TREES, dtype=np.uint64), ROOT_BRANCHES)[first:last]
    picks = (np.arange(TREES * ROOT_BRANCHES) % COORDINATES)[first:last]
    for batch in batches:
        values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
        nodes = mixed((values[:, picks].astype(np.uint64) << np.uint64(20)) + (tree << np.uint64(8)) + picks.astype(np.uint64))
        ids, labels = (np.repeat(batch.column(name).to_numpy(), len(picks)) for name in ("doc_id", "label"))
        columns = [nodes.ravel().astype(np.int64), ids, labels, np.full(len(ids), 2**62)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=NODE_ARROW)


def _branches(batches):
    for batch in batches:
        nodes = batch.column("node").to_numpy().astype(np.uint64)
        values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
        found = [children(nodes[k : k + 1], values[k], BRANCHES)[0] for k in range(len(nodes))]
        rest = [np.repeat(batch.column(name).to_numpy(), BRANCHES) for name in ("doc_id", "label", "n")]
        columns = [np.concatenate(found).astype(np.int64), *rest] if found else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=NODE_ARROW)


# Comparison by signature


PAIR_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def spanning_links(values: np.ndarray, blocks: np.ndarray) -> list[tuple[int, int]]:
    """Maximum spanning forest of the possible links, by places; pairs of one block count only if all are of it."""
    n = len(values)
    apart = bool((blocks != blocks[0]).any())
    best, link, out = np.full(n, -1), np.zeros(n, np.int64), np.ones(n, bool)
    at, found = 0, []
    for _ in range(n - 1):
        out[at] = False
        equal = (values == values[at]).sum(axis=1)
        if apart:
            equal[blocks == blocks[at]] = -1
        nearer = out & (equal > best)
        best[nearer], link[nearer] = equal[nearer], at
        at = int(np.argmax(np.where(out, best, -2)))
        if best[at] >= POSSIBLE:
            found.append((int(link[at]), at))
        else:
            best[at] = -1
    return found


def _values(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _compare(batches):
    """Stars of what the spanning links of nodes, or of two blocks of one, connect."""

    def found():
        arrays = [pa.array(c, pa.int64()) for c in stars(a, b)]
        return pa.RecordBatch.from_arrays(arrays, schema=PAIR_ARROW)

    a, b = [], []
    for rows in groups(batches, ("node", "low", "high")):
        ids, blocks = rows["doc_id"].to_numpy(), rows["block"].to_numpy()
        if rows["low"][0] != rows["high"][0] and (blocks == blocks[0]).all():
            continue
        for one, other in spanning_links(_values(rows), blocks):
            a.append(int(ids[one]))
            b.append(int(ids[other]))
        if len(a) > LINKS:
            yield found()
            a, b = [], []
    yield found()


def in_blocks(rows: DataFrame, count) -> DataFrame:
    """Rows with their block of ``count``, and the pair of blocks (low, high) to compare, for every such pair."""
    rows = rows.withColumn("blocks", F.greatest(count, F.lit(1)).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})


def connected(values: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Per place the first place of those that possible links or equal labels connect it with."""
    links = spanning_links(values, np.zeros(len(values), np.int64))
    _, first, same = np.unique(labels, return_index=True, return_inverse=True)
    places, least = stars([*range(len(values)), *(a for a, _ in links)], [*first[same].tolist(), *(b for _, b in links)])
    part = np.arange(len(values))
    part[places] = least
    return part


CROWD_SCHEMA = (
    "node long, n long, above long, doc_id long, label long, block int, own boolean, near boolean, star long, signature binary"
)
CROWD_ARROW = pa.schema(
    [
        *((name, pa.int64()) for name in ("node", "n", "above", "doc_id", "label")),
        ("block", pa.int32()),
        ("own", pa.bool_()),
        ("near", pa.bool_()),
        ("star", pa.int64()),
        ("signature", pa.binary()),
    ]
)


def _crowd(batches):
    for rows in groups(batches, ("node", "block")):
        # Sorted by id, so pivots have the same order in all blocks of a node, and the first place is the smallest id.
        ids, labels, pivots = (rows[name].to_numpy() for name in ("doc_id", "label", "pivot"))
        values, pivots = _values(rows), np.flatnonzero(pivots)
        among = connected(values[pivots], labels[pivots])
        centre = pivots[among == np.argmax(np.bincount(among))]
        part = connected(values, labels)
        near = np.isin(part, part[centre])
        made = {"label": np.where(near, labels[centre].min(), labels), "near": near, "star": ids[part]}
        columns = [pa.array(made[f.name], f.type) if f.name in made else rows[f.name].combine_chunks() for f in CROWD_ARROW]
        yield pa.RecordBatch.from_arrays(columns, schema=CROWD_ARROW)


def crowds(inside: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of large nodes (node, n, above, least, doc_id, label), each compared within its block and with the pivots.

    The pivots, about ``PIVOTS`` members of a node, are in all blocks of it; in all but one a row is not its member's
    ``own``. ``star`` is the smallest id that possible links or labels of the block connect a member with. The largest
    group of linked pivots is the node's centre; what a block connects with it is ``near`` and gets its label.
    """
    hashed = F.xxhash64("doc_id", "node")
    blocks = F.ceil(F.col("n") / BLOCK)
    home = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    pivot = (F.pmod(hashed, F.ceil(F.col("n") / PIVOTS)) == 0) | (F.col("doc_id") == F.col("least"))
    rows = inside.withColumns({"home": home, "pivot": pivot})
    everywhere = F.sequence(F.lit(0), blocks.cast("int") - 1)
    rows = rows.withColumn("block", F.explode(F.when(F.col("pivot"), everywhere).otherwise(F.array("home"))))
    rows = rows.withColumn("own", F.col("block") == F.col("home")).drop("home", "least")
    rows = rows.join(narrowed(classes.select("doc_id", "signature"), inside.select("doc_id")), "doc_id")
    rows = rows.repartition(shuffle_partitions(inside.sparkSession), "node", "block")
    return rows.sortWithinPartitions("node", "block", "doc_id").mapInArrow(_crowd, CROWD_SCHEMA)


def possible_links(classes: DataFrame, first: int = 0, last: int = TREES * ROOT_BRANCHES) -> DataFrame:
    """a, b: stars that connect what the possible links in all nodes of roots ``first`` to ``last`` connect.

    ``classes`` has doc_id, label, signature. A node whose classes all have one label is left out; small nodes of the
    same members are one. In a large node what is not near its centre is compared with all others, or, if that is much,
    the node branches.
    """
    members = land(classes.select("doc_id", "label", "signature").mapInArrow(partial(_roots, first, last), NODE_SCHEMA), "near-level")
    signed = classes.select("doc_id", "signature")
    key = ["node", "low", "high", "block", "doc_id"]
    finals, dealt, links = [], [], []
    for level in range(1, DEPTH + 1):
        nodes = members.groupBy("node").agg(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(F.xxhash64("doc_id")).alias("mark"),
            F.min("doc_id").alias("least"),
            F.max("above").alias("above"),
            F.min("label").alias("low"),
            F.max("label").alias("high"),
        )
        counted, small = Observation(), F.col("n") <= LEAF
        nodes = nodes.where("n > 1 and low < high").observe(counted, F.count_if(~small).alias("large"))
        nodes = land(nodes, "near-nodes")
        finals.append((members, nodes.where(small).select(F.lit(level).alias("level"), "node", "n", "mark", "least")))
        if not counted.get["large"]:
            break
        inside = members.select("node", "doc_id", "label").join(nodes.where(~small).select("node", "n", "above", "least"), "node")
        crowd = land(crowds(land(inside, "near-inside"), signed), "near-crowd")
        links.append(crowd.where("doc_id <> star").select(F.col("doc_id").alias("a"), F.col("star").alias("b")))
        own = crowd.where("own")
        rest = own.where("not near").groupBy("node").agg(F.count(F.lit(1)).alias("rest"))
        rest = rest.withColumn("few", F.col("rest") <= LEAF)
        many = Observation()
        rest = land(rest.observe(many, F.count_if(~F.col("few")).alias("n")), "near-rest")
        # The rest is a block by its own, -1, and meets every block of what is near.
        few = own.where("not near").join(rest.where("few").select("node"), "node")
        few = few.withColumns({"blocks": F.ceil(F.col("n") / BLOCK).cast("int"), "low": F.lit(-1), "block": F.lit(-1)})
        few = few.withColumn("high", F.explode(F.sequence(F.lit(-1), F.col("blocks") - 1)))
        near = own.where("near").withColumns({"low": F.lit(-1), "high": F.col("block")})
        dealt += [few.select(*key, "signature"), near.select(*key, "signature")]
        if not many.get["n"]:
            break
        apart = own.join(rest.where("not few").select("node"), "node")
        stays = (F.col("n") >= SHRINK * F.col("above")) | F.lit(level == DEPTH)
        dealt.append(in_blocks(apart.where(stays), F.ceil(F.col("n") / BLOCK)).select(*key, "signature"))
        on = apart.where(~stays).select("node", "n", "doc_id", "label", "signature")
        members = land(on.mapInArrow(_branches, NODE_SCHEMA).distinct(), "near-level")
    # The same members may meet again, at another level too.
    nodes = reduce(DataFrame.unionByName, [nodes for _, nodes in finals])
    one = nodes.groupBy("n", "mark", "least").agg(F.min(F.struct("level", "node")).alias("one"))
    one = land(one.select("one.level", "one.node"), "near-final")
    parts = [
        members.select("node", "doc_id").join(one.where(F.col("level") == level).select("node"), "node")
        for level, (members, _) in enumerate(finals, 1)
    ]
    whole = reduce(DataFrame.unionByName, parts).withColumns({name: F.lit(0) for name in ("low", "high", "block")})
    rows = reduce(DataFrame.unionByName, [whole.join(signed, "doc_id").select(*key, "signature"), *dealt])
    rows = rows.repartition(shuffle_partitions(classes.sparkSession), *key[:3]).sortWithinPartitions(*key[:3], "doc_id")
    found = rows.mapInArrow(_compare, "a long, b long")
    return reduce(DataFrame.unionByName, [found, *links])


def possible_clusters(classes: DataFrame) -> DataFrame:
    """node, label: classes connected by possible links.

    The first roots connect what is very alike. In the nodes of all others, which a large group of copies would fill
    with the same members once more, only classes of several clusters have something to tell.
    """
    alone = classes.withColumn("label", F.col("doc_id"))
    first = components(possible_links(alone, 0, FIRST_ROOTS))
    first = land(first, "near-first")
    labels = first.withColumnRenamed("node", "doc_id")
    labelled = classes.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    labelled = land(labelled.select("doc_id", "label", "signature"), "near-labelled")
    more = possible_links(labelled, FIRST_ROOTS)
    known = first.select(F.col("label").alias("a"), F.col("node").alias("b"))
    return components(more.unionByName(known))


# Confirmation on full sets


def similar_pairs(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the pairs of sets that are linked, from exact sizes of intersections.

    Shared shingles are counted a strip of ``COLUMNS`` of them at a time, as a product of 0/1 matrices.
    """
    n, sizes = len(sets), np.array([len(one) for one in sets], np.float64)
    owner = np.repeat(np.arange(n), sizes.astype(np.int64))
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    often = times[column] > 1
    owner, column = owner[often], place[column[often]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((n, n), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, [start, start + COLUMNS])
        strip = np.zeros((n, int(column[high - 1]) - start + 1), np.float32)
        strip[owner[low:high], column[low:high] - start] = 1
        shared += strip @ strip.T
    linked = (shared > 0) & (100.0 * shared >= LINK_PERCENT * (sizes[:, None] + sizes[None, :] - shared))
    np.fill_diagonal(linked, False)
    return linked


def local_components(linked: np.ndarray) -> np.ndarray:
    """Per place the first place of its component."""
    first = np.full(len(linked), -1)
    for start in range(len(linked)):
        if first[start] >= 0:
            continue
        first[start], todo = start, [start]
        while todo:
            for place in np.flatnonzero(linked[todo.pop()] & (first < 0)).tolist():
                first[place] = start
                todo.append(place)
    return first


LINK_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_links", pa.int64())])


def _confirm(batches):
    for rows in groups(batches, ("label", "low", "high")):
        # Sorted by id, so the first place of a component is its smallest id; one id may have several sets.
        ids, blocks = rows["doc_id"].to_numpy(), rows["block"].to_numpy()
        linked = similar_pairs([shingles(raw.as_py()) for raw in rows["raw"]])
        if (blocks != blocks[0]).any():
            linked &= blocks[:, None] != blocks[None, :]
        columns = [ids, ids[local_components(linked)], linked.sum(axis=1)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=LINK_ARROW)


def confirmed(clusters: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b, n_links: per class of a cluster (and pair of blocks) the smallest id it is connected with, and its links.

    ``clusters`` has node and label. A text travels once, in a cluster of several blocks once per block.
    """
    rows = clusters.withColumnRenamed("node", "doc_id").join(classes.select("doc_id", "n_shingles"), "doc_id")
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"))
    count = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES))
    key = ["label", "low", "high"]
    wanted = in_blocks(rows.join(sizes, "label"), count).select(*key, "block", "doc_id")
    texts = narrowed(_raw(docs), clusters.select(F.col("node").alias("doc_id")))
    dealt = wanted.join(texts, "doc_id").select(*key, "block", "doc_id", "raw")
    dealt = dealt.repartition(shuffle_partitions(docs.sparkSession), *key).sortWithinPartitions(*key, "doc_id")
    return dealt.mapInArrow(_confirm, "a long, b long, n_links long")


def duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, n_links for every row of ``docs``.

    ``n_links`` counts the links of the row's set to other sets. A row without words is a component of its own. A
    row without an id is linked with nothing and stays; its component_id is null. Rows of one id are one document
    that has all their texts.
    """
    sets = land(document_sets(docs), "near-sets")
    named = sets.where("digest is not null and doc_id is not null")
    classes = named.groupBy("digest").agg(
        F.min_by("signature", "doc_id").alias("signature"),
        F.first("n_shingles").alias("n_shingles"),
        F.min("doc_id").alias("doc_id"),
    )
    classes = land(classes, "near-classes")
    clusters = possible_clusters(classes)
    links = land(confirmed(clusters, classes, docs), "near-links")
    labels = components(links.select("a", "b"))

    degrees = links.groupBy("a").agg(F.sum("n_links").alias("n_links")).withColumnRenamed("a", "own")
    owners = classes.select("digest", F.col("doc_id").alias("own"))
    owners = owners.join(labels.withColumnRenamed("node", "own"), "own", "left").join(degrees, "own", "left")
    owners = owners.select("digest", F.coalesce("label", "own").alias("label"), "n_links")
    found = sets.join(owners, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    links_of = F.coalesce("n_links", F.lit(0)).alias("n_links")
    found = found.select("doc_id", "n_shingles", component.alias("component_id"), links_of)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay, one document per component; rows without an id stay."""
    dropped = duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
