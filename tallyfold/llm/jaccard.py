"""Jaccard join of word n-grams: blocks by equal parts of sets, T-occurrence search inside them.

A document's set holds the hashes of its distinct n-word shingles.  Equal sets
become one class first.

Blocks.  Two sets with Jaccard similarity t or more differ in at most
k = |A|(1-t)/t shingles.  Hash the shingles of either into P > k parts: at least
P - k parts are equal.  A set gives the hash of every part whose weight reaches
the weight of its (k+1)-th heaviest; fewer than P - k parts weigh less, so one of
the equal parts is given, and given by both, since an equal part weighs the same
in both.  A part weighs what it holds, shingles found in very many documents
counting least.  Sets that share a given part are in one block.  Sizes are classed
by powers of two, and a set whose partners may reach the next class gives its
parts there too.  Small sets with too many empty parts also give their shingle
prefix, which two such sets share.

Parities.  Chance parts put more and more sets into blocks as the corpus grows, and chain blocks that grow faster than it,
though few of their sets are similar.  So the sets of every block are first told apart by the parities of their
shingles, a bit or two for each shingle: two sets differ in at least as many shingles as their parities
differ in bits, so pairs beyond what similar sets may differ in are none.  Parities are made where texts are read, and
compared inside classes of sizes.  Sets connected by what is left make the blocks that are searched; texts are
sent for these alone.

Search.  A block's sets are dealt into chunks, each pair of chunks is a task.
There each set queries the inverted lists of the others by DivideSkip: its L
longest lists are put aside, the short ones are merged by a heap, documents on T - L or
more of them are kept, and these are looked up in the long lists by binary search.  A
set is not compared with those it is already connected to.  Only connections
leave a task, so a group of n near copies gives about n rows and not n squared.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.components import components
from tallyfold.llm.decontaminate import window_filter
from tallyfold.llm.tables import store, text_key
from tallyfold.llm.words import U64, flat, mix, shingle_sets, signed

CHUNK = 256  # sets of a block that one task side holds, about
OFTEN = 400  # a shingle in one of so many documents weighs least
TOGETHER = 1 << 20  # shingles that a task looks at together, about
MOST_OFTEN = 1_000_000  # 8 MB; which shingles these are changes speed, never results
MEMBER_BITS = 27  # of the filter of rows whose text is needed: 16 MB
BUCKET = 1 << 19  # shingles of the corpus for each bucket of parts
SIGNED = 1 << 20  # bytes of parities that one task side compares
TOLD = 2048  # sets of small blocks whose parities a task compares
WIDTH = 4  # of a class of sizes, in steps that similar sets may differ by
PARITIES = (8, 14)  # least and most bits of a set's parities, as powers of two
_MU = 0.0085  # DivideSkip's cost of a probe against a merge step
_PREFIX_TAG = 0x5851F42D4C957F2D
_SPARE_PARTS = 1.6

_PROFILE = "often boolean, doc_id long, crc long, n long, h1 long, h2 long"
_DEALT = pa.schema([(k, t) for k, t in zip(("bucket", "batch"), (pa.int32(), pa.int64()))] + [(k, pa.binary()) for k in ("part", "low", "high", "sets", "links")])
_DEALT_DDL = "bucket int, batch long, part binary, low binary, high binary, sets binary, links binary"
_STRIDE = 0x9E3779B97F4A7C15


def jaccard_groups(documents: DataFrame, percent: int = 80, n: int = 5, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, crc (of the text), n_shingles, component_id, kept.

    Sets link when 100 * intersection >= percent * union, for a percent above 50.  A-Z are lower-cased; fewer than
    n words are one shingle; null or empty texts have none and link with nothing.  Equal texts
    link.  A null id is never a component's smallest id; a component of null ids has a null one.
    Rows that share an id are separate.  ``kept`` marks the row with the smallest id (then checksum) of
    each component, and every row without shingles; equal rows are marked alike.  Other columns are
    not read.  No rows in, no rows out.
    Ids are whole numbers.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("crc", text_key(F.col("text")))
    profile = store(rows.mapInArrow(_profile(n), _PROFILE), "jaccard-profile")
    docs = profile.where("NOT often").drop("often")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "crc")).alias("first")
    sets = docs.where("n > 0").groupBy("h1", "h2", "n").agg(first, F.min("doc_id").alias("least"))
    sets = store(sets.select("h1", "h2", "n", "first.doc_id", "first.crc", "least", F.monotonically_increasing_id().alias("node")), "jaccard-sets")
    often = rows.sparkSession.sparkContext.broadcast(_often(profile, docs))
    shingles = docs.agg(F.sum("n")).first()[0] or 0
    bits = min(13, max(6, math.ceil(math.log2(shingles / BUCKET + 1))))
    dealt = rows.select("text").mapInArrow(_parts(n, percent, often, bits), _DEALT_DDL)
    near = store(dealt.groupBy("bucket").applyInArrow(_shared(bits), "a long, b long, named boolean"), "jaccard-near")
    blocks = components(near.where("NOT named").select("a", "b"), "jaccard-blocks").withColumnRenamed("root", "block")
    named = near.where("named").select(F.col("a").alias("node"), F.col("b").alias("h1"))
    blocks = named.join(blocks, "node").select("h1", "block").distinct()
    members = store(sets.join(blocks, "h1").select("node", "doc_id", "crc", "block"), "jaccard-members")
    links = _search_blocks(rows, _refined(rows, members, n, percent, 1), n, percent, chunk)
    groups = components(store(links, "jaccard-similar"), "jaccard")  # stored: a task runs one Python worker, not two
    joined = sets.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keeper = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "crc")).alias("keeper")
    of_group = store(joined.groupBy("root").agg(F.min("least").alias("component_id"), keeper), "jaccard-groups")
    known = joined.join(of_group, "root").select("h1", "h2", "n", "component_id", "keeper")
    out = ["doc_id", "crc", F.col("n").alias("n_shingles"), "component_id", "kept"]
    kept = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("crc") == F.col("keeper.crc"))
    found = docs.where("n > 0").join(known, ["h1", "h2", "n"]).withColumn("kept", kept).select(*out)
    empty = docs.where("n = 0").withColumn("component_id", F.col("doc_id")).withColumn("kept", F.lit(True)).select(*out)
    return found.unionByName(empty)


def _often(profile: DataFrame, docs: DataFrame) -> np.ndarray:
    """Shingles in one of OFTEN documents or more; their number is at most OFTEN mean set sizes."""
    least = max(64, docs.count() // OFTEN)
    counted = profile.where("often").groupBy("h1").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    rows = counted.orderBy(F.desc("n"), "h1").limit(MOST_OFTEN).select("h1").toArrow()
    return np.sort(rows["h1"].to_numpy().view(U64))


def _profile(n: int) -> Callable:
    """For each text: set size and a 128-bit identity of the set; and shingles in many of the texts looked at together."""
    schema = pa.schema([("often", pa.bool_()), ("doc_id", pa.int64()), ("crc", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, seen, every = 0, 0, []
            for sets in shingle_sets(*flat(batch.column("text")), n):
                size, both = _identities(sets)
                ids = [batch.column(k).slice(at, len(sets)) for k in ("doc_id", "crc")]
                no = pa.array(np.zeros(len(sets), dtype=bool))
                yield pa.RecordBatch.from_arrays([no, *ids, pa.array(size), signed(both[0]), signed(both[1])], schema=schema)
                every.append(np.concatenate(sets))
                at, seen = at + len(sets), seen + len(sets)
                if at < len(batch) and sum(map(len, every)) < TOGETHER:
                    continue
                shingle, count = _repeated(every, max(4, seen // OFTEN))
                seen, every = 0, []
                if len(shingle):
                    none = pa.nulls(len(shingle), pa.int64())
                    yes = pa.array(np.ones(len(shingle), dtype=bool))
                    yield pa.RecordBatch.from_arrays([yes, none, none, pa.array(count), signed(shingle), none], schema=schema)

    return profile


def _repeated(sets: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in ``least`` of the sets or more, and in how many."""
    every = np.concatenate([*sets, np.zeros(0, dtype=U64)])
    every.sort()
    shingle = np.unique(every[least - 1 :][every[least - 1 :] == every[: max(0, len(every) - least + 1)]])
    return shingle, np.searchsorted(every, shingle, side="right") - np.searchsorted(every, shingle)


def _identities(sets: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    size = np.array([len(s) for s in sets], dtype=np.int64)
    every = np.concatenate([*sets, np.zeros(1, dtype=U64)])  # one more, so that all starts exist
    starts = np.concatenate([[0], np.cumsum(size)])
    out = []
    for seed in (0x8A5CD789635D2DFF, 0x121FD2155C472F96):
        total = np.add.reduceat(mix(every ^ U64(seed)), starts)[:-1]
        total[size == 0] = 0
        out.append(mix(total + size.astype(U64)))
    return size, out


def _parts(n: int, percent: int, often, bits: int) -> Callable:
    """Parts given, packed by bucket; of sets looked at together one gives a part, the others are linked to it at once."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given, ids, count, at = [], [], 0, 0
            for sets in shingle_sets(*flat(batch.column("text")), n):
                at += len(sets)
                size, (identity, _) = _identities(sets)
                _, once = np.unique(identity, return_index=True)  # equal sets give the same parts
                once = once[size[once] * (100 - percent) // percent > 0]  # others link with equal sets only
                if len(once):
                    part, owner = _given([sets[i] for i in once], percent, often.value)
                    given.append((part, owner + count))
                    ids.append(identity[once])
                    count += len(once)
                if given and (at == len(batch) or sum(len(part) for part, _ in given) >= TOGETHER):
                    yield _dealt(*(np.concatenate(x) for x in zip(*given)), np.concatenate(ids), bits)
                    given, ids, count = [], [], 0

    return parts


def _dealt(part: np.ndarray, owner: np.ndarray, ids: np.ndarray, bits: int) -> pa.RecordBatch:
    """A row for each bucket (the first ``bits`` of a part): the next 48 bits of its parts, and the steps between the
    numbers of the sets that give them; and one row with all sets and the links between them.  Parts that are equal
    by accident put more sets into a block, which changes no result."""
    order = np.lexsort((owner, part))
    part, owner = part[order], owner[order]
    opens = np.concatenate([[True], part[1:] != part[:-1]])
    first = owner[np.flatnonzero(opens)[np.cumsum(opens) - 1]]
    pairs = np.unique((owner * len(ids) + first)[owner != first])
    part, owner = part[opens], owner[opens]
    bucket = (part >> U64(64 - bits)).astype(np.int32)
    order = np.lexsort((owner, bucket))
    part, owner, bucket = part[order], owner[order], bucket[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    step = np.diff(owner, prepend=0)
    step[cuts[:-1]] = owner[cuts[:-1]]
    short = ((part << U64(bits)) >> U64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    batch = int(mix(np.array([mix(ids.copy()).sum() + U64(len(ids))]))[0].view(np.int64))
    packed = [_binary(x, cuts, width) for x, width in ((short, 6), ((step & 255).astype(np.uint8), 1), ((step >> 8).astype("<u2"), 2))]
    none = pa.nulls(len(cuts) - 1, pa.binary())
    rows = [pa.array(bucket[cuts[:-1]]), pa.array([batch] * (len(cuts) - 1), pa.int64()), *packed, none, none]
    whole = [[batch % (1 << bits)], [batch], [None], [None], [None], [ids.astype("<u8").tobytes()], [pairs.astype("<i8").tobytes()]]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([x, pa.array(y, f.type)]) for x, y, f in zip(rows, whole, _DEALT)], schema=_DEALT)


def _binary(values: np.ndarray, cuts: np.ndarray, width: int) -> pa.Array:
    """The bytes of ``values`` between cuts."""
    offsets = pa.py_buffer((cuts * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _names(batch: np.ndarray, number: np.ndarray) -> np.ndarray:
    """64-bit names of the numbered sets of batches."""
    return mix(batch ^ (number.astype(U64) + U64(1)) * U64(_STRIDE))


def _shared(bits: int) -> Callable:
    """Links (a, b) of a bucket from each set to the least one with its part, and (named) the h1 of each set's name."""

    def shared(key: tuple, group: pa.Table) -> pa.Table:
        whole = group["part"].is_null().to_numpy()
        batch = group["batch"].to_numpy().view(U64)
        dealt = group.filter(pa.array(~whole))
        part, low, high = (np.frombuffer(b"".join(dealt[k].to_pylist()), dtype) for k, dtype in (("part", np.uint8), ("low", np.uint8), ("high", "<u2")))
        counts = np.array([len(x) for x in dealt["low"].to_pylist()], dtype=np.int64)
        number = np.cumsum(low + (high.astype(np.int64) << 8))
        begins = np.cumsum(counts) - counts
        number -= np.repeat(np.concatenate([[0], number])[begins], counts)
        a = _names(np.repeat(batch[~whole], counts), number)
        padded = np.zeros((len(a), 8), dtype=np.uint8)
        padded[:, :6] = part.reshape(-1, 6)
        part = padded.view("<u8").ravel()
        order = np.lexsort((a, part))
        part, a = part[order], a[order]
        opens = np.concatenate([[True], part[1:] != part[:-1]])[: len(part)]
        b = a[np.flatnonzero(opens)[np.cumsum(opens) - 1]]
        links = [np.unique(np.stack([a[a != b], b[a != b]], axis=1), axis=0)]
        names = [np.zeros((0, 2), dtype=U64)]
        for number, sets, pairs in zip(batch[whole], *(group[k].filter(pa.array(whole)).to_pylist() for k in ("sets", "links"))):
            ids, both = np.frombuffer(sets, dtype="<u8"), np.frombuffer(pairs, dtype="<i8")
            name = _names(np.full(len(ids), number), np.arange(len(ids)))
            names.append(np.stack([name, ids], axis=1))
            links.append(np.stack([name[both // len(ids)], name[both % len(ids)]], axis=1))
        every = np.concatenate([*links, *names])
        named = np.arange(len(every)) >= sum(map(len, links))
        return pa.table({"a": signed(every[:, 0]), "b": signed(every[:, 1]), "named": pa.array(named)})

    return shared


def _given(sets: list[np.ndarray], percent: int, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the parts that each set gives, and the index of the set."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    own = np.floor(np.log2(size)).astype(np.int64)  # exact: sizes are far below 2**48
    reach = np.flatnonzero(size * 100 // percent >= 2 << own)
    owner = np.concatenate([np.arange(len(sets)), reach])
    level = np.concatenate([own, own[reach] + 1])
    most = (2 << level) - 1  # largest size of the class
    n_parts = np.ceil(_SPARE_PARTS * (most * (100 - percent) / percent)).astype(np.int64) + 1
    length = size[owner]
    shingle = np.concatenate([sets[i] for i in owner])
    group = np.repeat(np.arange(len(owner)), length)
    spread = mix(shingle ^ (level.astype(U64) * U64(0xE7037ED1A0B428DB))[group])
    base = np.concatenate([[0], np.cumsum(n_parts)])
    cell = base[group] + (((spread >> U64(32)) * n_parts.astype(U64)[group]) >> U64(32)).astype(np.int64)
    total = int(base[-1])
    held = np.bincount(cell, minlength=total)
    rare = np.bincount(cell[~_among(shingle, often)], minlength=total)
    weight = np.where(rare > 0, rare + 1, np.minimum(held, 1))
    need = length * (100 - percent) // percent + 1
    floor = np.zeros(len(owner), dtype=np.int64)
    for w in range(1, 9):  # any weight that leaves enough parts is right; heavier ones are shared less
        enough = np.add.reduceat((weight >= w).astype(np.int64), base[:-1]) >= need
        floor[enough] = w
    of_part = np.repeat(np.arange(len(owner)), n_parts)
    at = np.flatnonzero((held > 0) & (weight >= floor[of_part]))
    mixed = mix(shingle.copy())
    low = np.bincount(cell, weights=(mixed & U64(0xFFFFFFFF)).astype(np.float64), minlength=total)  # exact below 2**53
    high = np.bincount(cell, weights=(mixed >> U64(32)).astype(np.float64), minlength=total)
    content = low[at].astype(U64) + (high[at].astype(U64) << U64(32))
    place = (at - base[of_part[at]]).astype(U64) + (level[of_part[at]].astype(U64) << U64(40))
    part = mix(mix(content) + place * U64(0x9E3779B97F4A7C15))
    owners = owner[of_part[at]]
    few = np.unique(owner[floor == 0])
    for i in few:
        prefix = sets[i][: size[i] - (-(-size[i] * percent // 100)) + 1]
        part = np.concatenate([part, mix(prefix ^ U64(_PREFIX_TAG))])
        owners = np.concatenate([owners, np.full(len(prefix), i)])
    return part, owners


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _texts(rows: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` with their texts."""
    return _sent(rows, members, "text string", lambda texts: [texts])


def _sent(rows: DataFrame, members: DataFrame, ddl: str, made: Callable) -> DataFrame:
    """``members`` with the columns that are made of their texts.  Rows that no member comes from are left out before they are dealt."""
    key = F.xxhash64("doc_id", "crc").alias("hash")
    keys = members.select(key)
    most = min(MEMBER_BITS, max(16, math.ceil(math.log2(32 * keys.count() + 1))))
    sent = rows.sparkSession.sparkContext.broadcast(window_filter(keys, most))
    names = ["doc_id", "crc", *(column.split()[0] for column in ddl.split(", "))]

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(sent.value.passes(batch.column("hash").to_numpy().view(U64))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("crc"), *made(batch.column("text"))], names=names)

    found = rows.select("doc_id", "crc", key, "text").mapInArrow(passing, f"doc_id long, crc long, {ddl}")
    same = found.doc_id.eqNullSafe(members.doc_id) & (found.crc == members.crc)
    return found.join(members.hint("merge"), same).drop("doc_id", "crc")  # alike at every size


def _in_pairs(rows: DataFrame) -> DataFrame:
    """Each row once for each chunk of its block, as ``low`` and ``high``, the lesser and the greater of both chunks."""
    other = F.col("other")
    every = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return every.withColumns({"low": F.least("chunk", other), "high": F.greatest("chunk", other)}).drop("other")


def _chunked(members: DataFrame, sizes: DataFrame) -> DataFrame:
    return members.join(sizes, "block").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))


def _refined(rows: DataFrame, members: DataFrame, n: int, percent: int, chunk: int) -> DataFrame:
    """Blocks that can hold similar sets.  Blocks of more than ``chunk`` sets become the components of their sets by
    parities."""
    sizes = store(members.groupBy("block").count().where("count > 1"), "jaccard-sizes")
    large = sizes.where(F.col("count") > chunk)
    small = members.join(sizes.where(F.col("count") <= chunk), "block", "left_semi").select("node", "doc_id", "crc", "block")
    if large.isEmpty():
        return store(small, "jaccard-refined")
    dealt = store(members.join(large, "block", "left_semi"), "jaccard-large")
    signed = store(_sent(rows, dealt, "size long, bits binary", _signatures(n)).select("block", "node", "size", "bits"), "jaccard-signed")
    links = store(_told_apart(signed, percent), "jaccard-resembling")
    found = components(links, "jaccard-parities")
    apart = dealt.join(found, "node").select("node", "doc_id", "crc", F.col("root").alias("block"))
    return store(small.unionByName(apart), "jaccard-refined")


def _told_apart(signed: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect the sets of a block which may be similar.

    The greater of two similar sets is in its class of sizes, and so is the lesser, which is put into each class
    that its partners reach.
    """
    ratio = 100 / percent * 1.0001  # more than similar sets differ by, so that no rounding parts them
    step = WIDTH * math.log(ratio)
    own, reach = (F.floor(F.log(F.col("size") * F.lit(x)) / F.lit(step)) for x in (1.0, ratio))
    classed = signed.withColumn("class", F.explode(F.sequence(own, reach)))
    chunks = F.ceil(F.sum(F.octet_length("bits") + 32) / SIGNED).cast("int").alias("chunks")
    classes = store(classed.groupBy("block", "class").agg(F.count("*").alias("count"), chunks).where("count > 1").drop("count"), "jaccard-classes")
    buckets = max(1, signed.count() // TOLD)  # small classes share tasks
    own = F.xxhash64("block", "class")
    small = F.col("chunks") == 1
    chunked = classed.join(classes, ["block", "class"]).withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    pairs = _in_pairs(chunked).select(
        F.when(small, F.pmod(own, F.lit(buckets))).otherwise(own).alias("task"),
        (~small).alias("large"), "low", "high", "block", "class", "node", "chunk", "size", "bits",
    )
    return pairs.groupBy("task", "large", "low", "high").applyInArrow(_resembling(percent), "a long, b long")


def _signatures(n: int) -> Callable:
    """For each text, its set's size and parities."""

    def signatures(texts: pa.Array) -> list[pa.Array]:
        size, bits = [], []
        for sets in shingle_sets(*flat(texts), n):
            size += [len(s) for s in sets]
            bits += [parities(s).tobytes() for s in sets]
        return [pa.array(size, pa.int64()), pa.array(bits, pa.binary())]

    return signatures


def _places(size: int) -> int:
    """Words of 64 bits that hold the parities of a set: equal within a class of sizes, as a power of two."""
    return (1 << min(PARITIES[1], max(PARITIES[0], size.bit_length()))) // 64


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each place, whether it has an odd number of the set's shingles.  The first half of the places and the second
    half, one against the other, are the parities at half as many places."""
    bits = _places(len(shingles)) * 64
    cell = (mix(shingles.copy()) & U64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=bits).astype(np.uint8) & 1, bitorder="little").view("<u8")


def _resembling(percent: int) -> Callable:
    def resembling(key: tuple, group: pa.Table) -> pa.Table:
        low, high = key[2].as_py(), key[3].as_py()
        block, level, node, size, chunk = (group[k].to_numpy() for k in ("block", "class", "node", "size", "chunk"))
        bits = group["bits"].to_pylist()
        order = np.lexsort((node, level, block))
        opens = (block[order][1:] != block[order][:-1]) | (level[order][1:] != level[order][:-1])
        links: list[tuple[int, int]] = []
        for rows in np.split(order, np.flatnonzero(opens) + 1):
            rows = rows[np.concatenate([[True], node[rows][1:] != node[rows][:-1]])]  # repeated rows bring a set twice
            side = chunk[rows] if low != high else None
            found = near_by_parities(size[rows], [np.frombuffer(bits[i], dtype="<u8") for i in rows], percent, side)
            links += [(int(node[rows[i]]), int(node[rows[j]])) for i, j in found]
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return resembling


def near_by_parities(size: np.ndarray, bits: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that connect all sets which may be similar by size and parities; with ``side``, pairs of unlike sides count
    only.  Similar sets of x and y shingles differ in (x + y) * (100 - percent) / (100 + percent) of them at most."""
    by_size = np.argsort(size, kind="stable")
    size = size[by_size]
    side = side[by_size] if side is not None else None
    words = np.array([len(bits[i]) for i in by_size])
    group = np.arange(len(size))
    found: list[tuple[int, int]] = []
    for width in np.unique(words).tolist():
        start, end = np.searchsorted(words, [width, width + 1]).tolist()
        stop = int(np.searchsorted(words, 2 * width, side="right"))
        own = np.stack([bits[i] for i in by_size[start:end]])
        wider = [bits[i][:width] ^ bits[i][width:] for i in by_size[end:stop]]
        every = np.concatenate([own, np.stack(wider)]) if wider else own
        for x in range(start, end):
            last = min(stop, int(np.searchsorted(size, size[x] * 100 // percent, side="right")))
            free = group[x + 1 : last] != group[x]
            if side is not None:
                free &= side[x + 1 : last] != side[x]
            if not free.any():
                continue
            differ = np.bitwise_count(every[x + 1 - start : last - start] ^ every[x - start]).sum(axis=1, dtype=np.int64)
            for y in (x + 1 + np.flatnonzero(free & (differ * (100 + percent) <= (size[x] + size[x + 1 : last]) * (100 - percent)))).tolist():
                if group[y] != group[x]:
                    group[group == group[y]] = group[x]
                    found.append((int(by_size[x]), int(by_size[y])))
    return found


def _search_blocks(rows: DataFrame, members: DataFrame, n: int, percent: int, chunk: int) -> DataFrame:
    """Links (a, b) between nodes of a block that connect what the block's similar sets connect."""
    count = F.count("*")
    each = F.least(F.greatest(F.lit(chunk), F.sqrt(count * chunk)), F.lit(4 * chunk))  # larger blocks have larger chunks
    sizes = members.groupBy("block").agg(F.ceil(count / each).cast("int").alias("chunks"))
    buckets = max(1, members.count() // chunk)  # small blocks share tasks
    texts = _texts(rows, _chunked(members, sizes))
    small = F.col("chunks") == 1
    pairs = _in_pairs(texts).select(
        F.when(small, F.pmod(F.xxhash64("block"), F.lit(buckets))).otherwise(F.col("block")).alias("task"),
        (~small).alias("large"), "low", "high", "block", "node", "chunk", "text",
    )
    return pairs.groupBy("task", "large", "low", "high").applyInArrow(_search(n, percent), "a long, b long")


def _search(n: int, percent: int) -> Callable:
    def search(key: tuple, group: pa.Table) -> pa.Table:
        low, high = key[2].as_py(), key[3].as_py()
        block, node, chunk = (group[k].to_numpy() for k in ("block", "node", "chunk"))
        order = np.lexsort((node, block))
        cuts = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1]]))
        links: list[tuple[int, int]] = []
        for rows in np.split(order, cuts[1:]):
            rows = rows[np.concatenate([[True], node[rows][1:] != node[rows][:-1]])]  # repeated rows bring a set twice
            if len(rows) > 1:
                sets = list(chain.from_iterable(shingle_sets(*flat(group["text"].take(pa.array(rows)).combine_chunks()), n)))
                side = chunk[rows] if low != high else None
                links += [(int(node[rows[i]]), int(node[rows[j]])) for i, j in connections(sets, percent, side)]
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return search


def occurrences(ordered: list[list[int]], need: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers on ``need`` or more of some sorted lists, none of them empty, and on how many.

    A heap holds the head of each list.  When its least number is on too few lists, the ``need`` - 1 lists with
    the least heads cannot bring an earlier one to ``need``, so they jump to the next head by binary search.
    """
    at = [0] * len(ordered)
    heap = [(heads[0], k) for k, heads in enumerate(ordered)]
    heapify(heap)
    numbers, counts = [], []
    while len(heap) >= need:
        number, taken = heap[0][0], []
        while heap and heap[0][0] == number:
            taken.append(heappop(heap)[1])
        if len(taken) >= need:
            numbers.append(number)
            counts.append(len(taken))
            number += 1
        else:
            while heap and len(taken) < need - 1:
                taken.append(heappop(heap)[1])
            if not heap:
                break
            number = heap[0][0]
        for k in taken:
            at[k] = bisect_left(ordered[k], number, at[k])
            if at[k] < len(ordered[k]):
                heappush(heap, (ordered[k][at[k]], k))
    return np.array(numbers, dtype=np.int64), np.array(counts, dtype=np.int64)


def connections(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of similar sets that connect whatever similar pairs connect; with ``side``, pairs of unlike sides count only.

    T-occurrence search over the inverted lists of these sets.
    """
    size = np.array([len(s) for s in sets])
    by_size = np.argsort(size, kind="stable")  # a set looks for partners after it: no smaller ones
    size = size[by_size]
    count = len(sets)
    tokens, token_of = np.unique(np.concatenate([sets[i] for i in by_size]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(token_of, kind="stable")  # the lists, one after the other, each in order of size
    lists = np.repeat(np.arange(count), size)[order]
    offset = np.concatenate([[0], np.cumsum(np.bincount(token_of, minlength=len(tokens)))])
    entries = token_of[order] * count + lists  # sorted: list, then set
    sides = side[by_size] if side is not None else None
    group = np.arange(count)
    found: list[tuple[int, int]] = []
    for x in range(count - 1):
        last = int(np.searchsorted(size, size[x] * 100 // percent, side="right"))  # larger ones are too large
        free = group[x + 1 : last] != group[x]
        if sides is not None:
            free &= sides[x + 1 : last] != sides[x]
        if not free.any():
            continue
        own = token_of[starts[x] : starts[x + 1]]
        length = offset[own + 1] - offset[own]
        least = -(-2 * percent * int(size[x]) // (100 + percent))  # T, for a partner of this size
        aside = min(least - 1, int(least / (_MU * np.log2(max(2, length.max())) + 1)))  # L
        own = own[np.argsort(length, kind="stable")]
        short, long = own[: len(own) - aside], own[len(own) - aside :]
        need = least - aside
        first, end = (np.searchsorted(entries, short * count + at) for at in (x + 1, last))  # the partners' stretch
        filled = np.flatnonzero(end > first)
        if len(filled) < need:
            continue
        held = [lists[i:j].tolist() for i, j in zip(first[filled].tolist(), end[filled].tolist())]
        candidates, seen = occurrences(held, need)
        new = free[candidates - x - 1]
        candidates, seen = candidates[new], seen[new]
        for start in range(0, len(candidates), 64):
            part, short_hits = candidates[start : start + 64], seen[start : start + 64]
            new = group[part] != group[x]
            part, short_hits = part[new], short_hits[new]
            if not len(part):
                continue
            wanted = (long[:, None] * count + part[None, :]).ravel()
            at = np.minimum(np.searchsorted(entries, wanted), len(entries) - 1)
            overlap = short_hits + (entries[at] == wanted).reshape(len(long), len(part)).sum(axis=0)
            for y in part[100 * overlap >= percent * (size[x] + size[part] - overlap)].tolist():
                if group[y] != group[x]:
                    group[group == group[y]] = group[x]
                    found.append((int(by_size[x]), int(by_size[y])))
    return found
