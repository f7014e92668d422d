"""Near-duplicate classes by BagMinHash signatures, bands and exact verification.

A text is the bag of its five-word shingles. An element that occurs w times
owns the discretised weights 1..w; weights lie in dyadic intervals [0,1), [1,2),
[2,4), ..., and each interval of each element is a Poisson process of points in
time whose rate is the interval's length. A point belongs to a random signature
place and to a random weight of its interval, found by halving; it counts if
the weight is below w. The earliest point of a place is its value, so two texts
agree in a place with the probability of their weighted Jaccard similarity.
Points are made in order of time up to a horizon; texts with a place still
empty are done again with twice the horizon, so signatures are exact.

Bands of the signature propose links: texts that agree in a band share a bucket.
Equal bags are one node from the start, and buckets with the same members are
one. A bucket's members are dealt into blocks of bounded size. In a block the
weighted Jaccard similarities of all pairs are exact (products of 0/1 matrices
over the elements that the block shares), and only the links that join two
classes come out, fewer than it has members. A first round compares within
blocks; the blocks of a large bucket differ from band to band, so large groups
of copies join in linear work. The second round makes up what is left: in
buckets of several blocks, members that are still in different classes are
compared block by block; the meetings of a bucket's blocks are dealt out to as
many tasks as it has groups of SALT blocks. No link is lost to a cap, and no
pairs of rows are listed.

Defined results: null texts and texts without a word stand alone; texts of one
to four words are one shingle; rows that repeat a doc_id or a text share a
class if their texts do; null doc_ids are kept. Columns other than doc_id and
text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isolume.llm.common import fingerprint, same_row, spread, stored, unused
from isolume.operators.components import components
from isolume.llm.textnp import bags, buffers, mix, pieces

SHINGLE, SIMILARITY = 5, 0.8
#: A pair at 0.8 shares no band with probability (1 - 0.8 ** 5) ** 25 = 5e-5, and less above.
BANDS, ROWS = 25, 5
PLACES = BANDS * ROWS
#: Members of a bucket that are compared with each other, or with as many others, at once.
BLOCK = 256
#: Blocks of a bucket whose meetings with all its blocks are listed by one task.
SALT = 16
#: Elements of a block whose columns are held at once.
COLUMNS = 1 << 14
#: Bytes of text that are held as arrays at once.
AT_ONCE = 4 << 20
#: Rows of about 50 bytes that may be broadcast.
BROADCAST_ROWS = 200_000
#: A group of more than this share of all rows (one in HOT) is joined by broadcast, not in a task of its own.
HOT = 1000

_U = np.uint64
#: A draw's high 40 bits are a time and its low 24 bits a place (no two places need the same rate).
_UNIT = 2.0**-40


def _bag_minhash(shingle: np.ndarray, count: np.ndarray, doc: np.ndarray, total: np.ndarray, widen: float = 3.0) -> np.ndarray:
    """Signatures (texts x PLACES) of float64 times; doc numbers are 0.. in order and every doc has elements."""
    out = np.full((len(total), PLACES), np.inf)
    flat = out.reshape(-1)
    horizon = (np.log(PLACES) + widen) / total
    for level in range(int(count.max(initial=1) - 1).bit_length() + 1):
        lo, size = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        live = np.flatnonzero(count > lo)
        seed, weight, who = mix(shingle[live] + _U(level * 0x632BE5AB + 1)), count[live], doc[live]
        until, base, time = horizon[who], who * PLACES, np.zeros(len(live))
        step = 0
        while len(seed):
            draw = mix(seed + _U((step + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            gap = (draw >> _U(24)).astype(np.float64)
            gap += 1
            gap *= _UNIT
            np.log(gap, out=gap)
            gap /= -(PLACES * size)
            time = time + gap
            on = np.flatnonzero(time < until)
            seed, weight, until, base, time, draw = seed[on], weight[on], until[on], base[on], time[on], draw[on]
            if not len(on):
                break
            at = base + ((draw & _U(0xFFFFFF)) % _U(PLACES)).astype(np.int64)
            if size > 1:
                half = (mix(draw) & _U(size - 1)).astype(np.int64)  # each bit halves the interval once
                owns = lo + half < weight
                np.minimum.at(flat, at[owns], time[owns])
            else:
                np.minimum.at(flat, at, time)
            step += 1
    short = np.flatnonzero(np.isinf(out).any(axis=1))
    if len(short):
        again = np.full(len(total), -1)
        again[short] = np.arange(len(short))
        rows = np.flatnonzero(again[doc] >= 0)
        wider = 2 * (np.log(PLACES) + widen) - np.log(PLACES)
        out[short] = _bag_minhash(shingle[rows], count[rows], again[doc[rows]], total[short], wider)
    return out


_SIGNED = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64()))])
_SIGNED_DDL = "doc_id long, fp long, node binary, bands array<long>"


def sign(texts: pa.Array) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
    """(name of the bag or None, band hashes, 32-bit signature places) of each text."""
    keys, count, total = bags(texts, SHINGLE)
    doc, shingle = (keys >> _U(48)).astype(np.int64), keys & _U((1 << 48) - 1)
    has = np.flatnonzero(total)
    nodes: list[bytes | None] = [None] * len(total)
    bands, places = np.zeros((len(total), BANDS), np.int64), np.zeros((len(total), PLACES), np.uint32)
    if len(has):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        halves = [np.add.reduceat(mix(mix(shingle + _U(s)) + count.astype(_U) * _U(0xD6E8FEB86659FD93)), first) for s in (0x1234567, 0x7654321)]
        for i, x, y in zip(has.tolist(), halves[0].tolist(), halves[1].tolist(), strict=True):
            nodes[i] = x.to_bytes(8, "big") + y.to_bytes(8, "big")
        dense = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
        times = _bag_minhash(shingle, count, dense, total[has].astype(np.float64))
        values = mix(times.view(_U))
        places[has] = (values >> _U(32)).astype(np.uint32)
        band = np.zeros((len(has), BANDS), _U) + np.arange(BANDS, dtype=_U)
        for r in range(ROWS):
            band = mix(band * _U(0x9E3779B97F4A7C15) + values[:, r::ROWS])
        bands[has] = band.view(np.int64)
    return nodes, bands, places


def _sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.diff(buffers(batch.column("text"))[1])
        for part in pieces(sizes, AT_ONCE, 4096):
            rows = batch.slice(part.start, part.stop - part.start)
            nodes, bands, _ = sign(rows.column("text"))
            at = np.arange(len(nodes) + 1, dtype=np.int32) * BANDS
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(bands.reshape(-1)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("fp"), pa.array(nodes, pa.binary()), lists], schema=_SIGNED)


def elements(texts: pa.Array) -> list[np.ndarray]:
    """The elements of each text: a shingle that occurs w times is w elements, so shared elements are the bags' common weight."""
    keys, count, total = bags(texts, SHINGLE)
    turn = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    each = mix((np.repeat(keys & _U((1 << 48) - 1), count) << _U(1)) + turn.astype(_U) * _U(0xA0761D6478BD642F))
    return np.split(each, np.cumsum(total)[:-1])


def _bag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(np.diff(buffers(batch.column("text"))[1]), AT_ONCE, 4096):
            rows = batch.slice(part.start, part.stop - part.start)
            found = pa.array([e.tobytes() for e in elements(rows.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("node"), found], ["node", "bag"])


def similarities(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Weighted Jaccard similarity of every bag on the left with every one on the right (or on the left again)."""
    every = left + (right or [])
    size = np.array([len(e) for e in every])
    row = np.repeat(np.arange(len(every)), size)
    _, code, seen = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    shared = seen[code] > 1  # an element of one bag only adds nothing
    row, code = row[shared], code[shared]
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    a = len(left)
    common = np.zeros((a, len(right) if right is not None else a), np.float32)
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        i, j = np.searchsorted(code, [first, first + COLUMNS])
        held = np.zeros((len(every), min(COLUMNS, int(code[-1]) + 1 - first)), np.float32)
        held[row[i:j], code[i:j] - first] = 1
        common += held[:a] @ (held[a:] if right is not None else held).T
    total = size[:a, None] + (size[a:] if right is not None else size)[None, :]
    return common / np.maximum(total - common, 1)


def joining_links(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) of near that join two classes, until none is left; left and right: class numbers of rows and columns."""
    left, right, out = left.copy(), right.copy(), []
    while True:
        i, j = np.unravel_index(np.argmax(near & (left[:, None] != right[None, :])), near.shape)
        if not near[i, j] or left[i] == right[j]:
            return out
        old, new = right[j], left[i]
        left[left == old] = new
        right[right == old] = new
        out.append((int(i), int(j)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each key, of batches sorted by key; one block is held at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = batch.column("key").to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and keys[a] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _sides(block: pa.Table) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    """(names, class numbers, bags) of a block's rows."""
    names = block.column("node").to_pylist()
    roots = block.column("root").to_pylist()
    numbers = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    return names, np.array([numbers[r] for r in roots]), [np.frombuffer(x, _U) for x in block.column("bag").to_pylist()]


def _compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join classes, of each block: rows of side a with those of side b, or with each other if there is no b."""
    for block in _blocks(batches):
        if block.num_rows < 2:
            continue
        names, number, found = _sides(block)
        side = block.column("side").to_numpy()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(np.unique(number)) < 2 or not len(a):
            continue
        left = [found[i] for i in a]
        if len(b):
            near = similarities(left, [found[i] for i in b]) >= SIMILARITY
        else:
            b = a
            near = np.triu(similarities(left) >= SIMILARITY, 1)
        links = joining_links(near, number[a], number[b])
        if links:
            u, v = [names[a[i]] for i, _ in links], [names[b[j]] for _, j in links]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])


def _compared(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Links (u, v) of blocks of (key, side, node, root)."""
    rows = blocks.join(found, "node").select("key", "side", "node", "root", "bag")
    return rows.repartition("key").sortWithinPartitions("key", "side").mapInArrow(_compare_batches, "u binary, v binary")


def _bags(rows: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, bag) of nodes that share a bucket; the text of one row stands for its node."""
    wanted = stored(reps.join(nodes.distinct(), "node", "left_semi"), "near_wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted.hint("shuffle_hash")
    found = rows.join(wanted, same_row(rows, wanted)).select("node", rows["text"])
    return stored(found.mapInArrow(_bag_batches, "node binary, bag binary").dropDuplicates(["node"]), "near_bags")


def _with(rows: DataFrame, each: DataFrame, key: str) -> DataFrame:
    """rows with the columns of each, which holds one row a key, its number n of rows among them; nulls where it has none.

    Keys of more than one in HOT of all the rows, so fewer than HOT keys at any size, are broadcast: no group's rows
    come together in one task, however many there are. Rows without a key stay where they are; the others are shuffled.
    """
    total = each.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT > total
    own = [c for c in each.columns if c != key]
    first = rows.join(F.broadcast(each.filter(hot)), key, "left")
    rest = first.filter(F.col("n").isNull() & F.col(key).isNotNull()).drop(*own).join(each.filter(~hot), key, "left")
    return first.filter(F.col("n").isNotNull() | F.col(key).isNull()).unionByName(rest)


def near_classes(docs: DataFrame) -> DataFrame:
    """Returns for every row of docs: doc_id, fp (of its text), root (its class; null if it stands alone without words)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", fingerprint(F.col("text")).alias("fp"))
    signed = stored(spread(rows).mapInArrow(_sign_batches, _SIGNED_DDL), "near_signed")
    node = signed.filter(F.col("node").isNotNull()).groupBy("node")
    reps = stored(node.agg(F.min(F.struct("doc_id", "fp")).alias("row"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n")).select("node", "row.doc_id", "row.fp", "bands", "n"), "near_nodes")

    members = reps.select("node", F.explode("bands").alias("band"))
    same = F.sum(F.xxhash64("node").cast("decimal(38,0)"))  # buckets of one size and sum have the same members
    buckets = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), same.alias("same")).filter("n > 1")
    buckets = stored(buckets.groupBy("n", "same").agg(F.min("band").alias("band")).select("band", "n"), "near_buckets")
    members = stored(members.join(buckets, "band"), "near_members")
    bags_ = _bags(rows, reps.drop("bands", "n"), members.select("node"))

    dealt = lambda n: F.pmod(F.xxhash64("node", "band"), F.ceil(F.col(n) / BLOCK))
    blocks = members.select(F.xxhash64("band", dealt("n")).alias("key"), F.lit(0).alias("side"), "node", F.col("node").alias("root"))
    links = stored(_compared(blocks, bags_), "near_links")
    classes = components(links)

    # Buckets of several blocks: a large class has blocks of its own, which needn't meet each other; small classes share some.
    wide = members.filter(F.col("n") > BLOCK).select("band", "node").join(classes, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    wide = stored(wide, "near_wide")
    groups = wide.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = groups.groupBy("band").agg(F.count(F.lit(1)).alias("classes"), F.sum(F.when(F.col("n") < BLOCK, F.col("n"))).alias("small")).filter("classes > 1")
    large = groups.filter(F.col("n") >= BLOCK).select("band", "root", "n")
    shared = F.lit(b"")
    open_ = wide.join(mixed, "band").join(large, ["band", "root"], "left")
    whose = F.when(F.col("n").isNotNull(), F.col("root")).otherwise(shared)
    count = F.ceil(F.coalesce("n", "small") / BLOCK)
    open_ = open_.select("band", "node", "root", whose.alias("whose"), F.pmod(F.xxhash64("node"), count).cast("int").alias("part"))
    open_ = stored(open_, "near_open")
    per_block = stored(open_.select("band", "whose", "part").distinct(), "near_blocks")
    salts = per_block.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / SALT).alias("salts"))
    per_block = per_block.join(salts, "band")
    a = per_block.select("band", F.col("whose").alias("whose_a"), F.col("part").alias("part_a"), F.pmod(F.xxhash64("whose", "part"), "salts").alias("salt"))
    b = per_block.select("band", F.col("whose").alias("whose_b"), F.col("part").alias("part_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"))
    in_order = F.struct("whose_a", "part_a") <= F.struct("whose_b", "part_b")
    meet = a.join(b, ["band", "salt"]).drop("salt").filter(in_order & ((F.col("whose_a") == shared) | (F.col("whose_a") != F.col("whose_b"))))
    meet = stored(meet.withColumn("key", F.xxhash64("band", "whose_a", "part_a", "whose_b", "part_b")), "near_meet")
    itself = (F.col("whose_a") == F.col("whose_b")) & (F.col("part_a") == F.col("part_b"))
    sides = meet.select("band", "key", F.lit(0).alias("side"), F.col("whose_a").alias("whose"), F.col("part_a").alias("part"))
    sides = sides.unionByName(meet.filter(~itself).select("band", "key", F.lit(1).alias("side"), F.col("whose_b").alias("whose"), F.col("part_b").alias("part")))
    blocks = sides.join(open_, ["band", "whose", "part"]).select("key", "side", "node", "root")
    more = stored(_compared(blocks, bags_), "near_more_links")
    if not more.isEmpty():
        classes = components(links.unionByName(more))
    each = stored(reps.select("node", "n").join(classes, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n"), "near_roots")
    return _with(signed.select("doc_id", "fp", "node"), each, "node").select("doc_id", "fp", "root")


def classes_of(docs: DataFrame) -> DataFrame:
    """Returns for every row of docs: doc_id, class_id (the least doc_id of its class), class_size."""
    found = stored(near_classes(docs), "near_found")
    each = found.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    out = _with(found, stored(each, "near_classes"), "root")
    alone = F.col("root").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n", F.lit(1)).cast("long").alias("class_size"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, that of the least doc_id; rows that stand alone stay.

    Of rows equal in doc_id and text that with the least hash of all its columns stays, so reruns agree.
    """
    found = stored(near_classes(docs), "near_found")
    first = found.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("row")).select("row.*")
    alone = found.filter(F.col("root").isNull()).select("doc_id", "fp").distinct().withColumn("alone", F.lit(True))
    stay = first.withColumn("alone", F.lit(False)).unionByName(alone)
    of, single, turn = (unused(n, docs.columns, stay.columns) for n in ("__fp", "__alone", "__turn"))
    stay = stay.select(F.col("doc_id").alias(unused("__stays", docs.columns)), F.col("fp").alias(unused("__stays_fp", docs.columns)), F.col("alone").alias(single))
    marked = docs.withColumn(of, fingerprint(F.col("text")))
    joined = marked.join(stay, marked["doc_id"].cast("long").eqNullSafe(stay[stay.columns[0]]) & (marked[of] == stay[stay.columns[1]]))
    joined = joined.select(*[marked[c] for c in marked.columns], single)
    every = F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes])
    classed = joined.filter(~F.col(single)).withColumn(turn, F.row_number().over(Window.partitionBy("doc_id", of).orderBy(every)))
    return classed.filter(F.col(turn) == 1).select(*docs.columns).unionByName(joined.filter(single).select(*docs.columns))
