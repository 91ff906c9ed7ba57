"""Near-duplicate vectors by int8 tile products with proven error bounds.

Equal vectors of a label become one class first.  The classes of a label are
dealt into tiles of about ``tile`` vectors, and the tiles into groups; every pair of
groups of a label is one task, which multiplies the int8 codes of their pairs of tiles.  With T tiles
there are about the square root of T groups, and so often is a tile sent, as long as two
groups fit in ``TOGETHER`` bytes each.  A unit vector u is s*q + e with whole
q in [-127, 127], so for two of them

    |u.v - s_u s_v q_u.q_v|  <=  |s_u q_u| |e_v| + |e_u| |v|

where all norms are known per vector.  Pairs surely above the threshold are
linked and pairs surely below it are dropped; the rest are computed again from
the full vectors in double precision.  A task gives one row per linked vector
(its links and one neighbour in its group), never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tallyfold.llm.components import components
from tallyfold.llm.tables import store

TILE = 1024
TOGETHER = 64 << 20  # bytes of codes and vectors of one group of tiles, at most
_SLACK = 1e-6  # above every rounding error of the float operations behind a bound

_TILE_SCHEMA = "label long, dim int, tile int, tiles int, nodes binary, copies binary, codes binary, bounds binary, vectors binary"
_LINK_SCHEMA = "node long, root long, links long"


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Rows with a null label, and vectors that are null, empty, zero or hold null or non-finite
    components, link with nothing; nor do vectors of different lengths.  Repeated vectors link with
    each other.  A null id never is a component's smallest id; a component of null ids has a null
    one and keeps none of its rows.  Other columns are not read.  No rows in, no rows out.
    Ids and labels are whole numbers; vectors of floats or doubles.
    """
    element = vectors.schema[vector_col].dataType.elementType
    kind = "float" if isinstance(element, FloatType) else "double"
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("v")
    )
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    keys = [F.xxhash64(F.lit(k), "label", "v").alias(f"k{k}") for k in (1, 2)]
    rows = rows.withColumn("v", F.when(usable, F.col("v"))).withColumn("label", F.when(usable, F.col("label")))
    classes = (
        rows.where("v IS NOT NULL")
        .groupBy("label", "v")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .select(*keys, "label", "v", "least", "copies", F.monotonically_increasing_id().alias("node"))
    )
    classes = store(classes, "embedding-classes")
    linked = store(_links(classes, threshold, tile), "embedding-links")
    groups = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")), "embedding")
    least = classes.select("node", "least").join(groups, "node").groupBy("root").agg(F.min("least").alias("group_least"))
    least = store(least, "embedding-groups")  # read again, so that Spark may split a large group's rows in the join
    of_node = groups.join(least, "root").select("node", "group_least")
    counted = linked.groupBy("node").agg(F.sum("links").alias("links"))
    known = (
        classes.select("k1", "k2", "node", "least", "copies")
        .join(counted, "node", "left")
        .join(of_node, "node", "left")
        .select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("group_least", "least").alias("component_id"))
    )
    keyed = rows.select("vec_id", *(F.when(F.col("v").isNotNull(), k).alias(f"k{i}") for i, k in enumerate(keys, 1)))
    alone = keyed.where("k1 IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = keyed.where("k1 IS NOT NULL").join(known, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(classes: DataFrame, threshold: float, tile: int) -> DataFrame:
    rows = classes.select("label", F.size("v").alias("dim"), "node", "copies", "v")
    sizes = rows.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"), F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = rows.join(sizes, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    tiles = store(dealt.groupBy("label", "dim", "tile").applyInArrow(_pack, _TILE_SCHEMA), "embedding-tiles")
    side = F.least(F.ceil(F.sqrt("tiles")), F.greatest(F.lit(1), F.floor(F.lit(TOGETHER) / (F.col("dim") * (5 * tile)))))
    grouped = tiles.withColumn("side", side.cast("int")).withColumn("own", F.floor(F.col("tile") / F.col("side")).cast("int"))
    groups = F.ceil(F.col("tiles") / F.col("side")).cast("int")
    other = F.col("other")
    pairs = grouped.withColumn("other", F.explode(F.sequence(F.lit(0), groups - 1))).select(
        "*", F.least("own", other).alias("low"), F.greatest("own", other).alias("high")
    )
    match = _matcher(threshold)
    return pairs.groupBy("label", "dim", "low", "high").applyInArrow(match, _LINK_SCHEMA)


def _pack(group: pa.Table) -> pa.Table:
    """A tile as one row: int8 codes, and for each vector its scale, code norm and error norm."""
    dim = group["dim"][0].as_py()
    vectors = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(group), dim)
    wide = vectors.astype(np.float64)
    unit = wide / np.abs(wide).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    close = scale[:, None] * codes
    bounds = np.stack([scale, np.linalg.norm(close, axis=1), np.linalg.norm(unit - close, axis=1)])
    row = {
        "label": group["label"][0].as_py(), "dim": dim, "tile": group["tile"][0].as_py(), "tiles": group["tiles"][0].as_py(),
        "nodes": group["node"].to_numpy().tobytes(), "copies": group["copies"].to_numpy().tobytes(),
        "codes": codes.tobytes(), "bounds": bounds.tobytes(), "vectors": vectors.tobytes(),
    }
    types = {"label": pa.int64(), "dim": pa.int32(), "tile": pa.int32(), "tiles": pa.int32()}
    return pa.table({k: pa.array([v], type=types.get(k, pa.binary())) for k, v in row.items()})


def _matcher(threshold: float):
    def match(key: tuple, group: pa.Table) -> pa.Table:
        dim, low, high = (k.as_py() for k in key[1:])
        order = np.argsort(group["tile"].to_numpy())  # the same pairs in the same order in every attempt
        tiles = [(group["own"][int(i)].as_py(), _unpack(group, int(i), dim)) for i in order]
        rows = [_of_pair(left, right, threshold) for i, (a, left) in enumerate(tiles) for b, right in tiles[i:] if (a, b) == (low, high)]
        return pa.concat_tables([_rows([], [], []), *rows])

    return match


def _of_pair(left: dict, right: dict, threshold: float) -> pa.Table:
    """Links between two tiles, or inside one."""
    linked = _linked(left, right, threshold)
    if left is right:
        np.fill_diagonal(linked, False)
        links = linked @ left["copies"]
        root = _roots(linked)
        at = np.flatnonzero(links)
        return _rows(left["nodes"][at], left["nodes"][root[at]], links[at])
    root = _roots(linked, bipartite=True)
    nodes, links = np.concatenate([left["nodes"], right["nodes"]]), np.concatenate([linked @ right["copies"], left["copies"] @ linked])
    at = np.flatnonzero(links)
    return _rows(nodes[at], nodes[root[at]], links[at])


def _rows(nodes, roots, links) -> pa.Table:
    return pa.table({k: pa.array(np.asarray(v, dtype=np.int64)) for k, v in (("node", nodes), ("root", roots), ("links", links))})


def _unpack(group: pa.Table, row: int, dim: int) -> dict[str, np.ndarray]:
    count = len(group["nodes"][row].as_py()) // 8
    wide = len(group["vectors"][row].as_py()) == 8 * dim * count  # doubles, as the table holds them
    types = {"nodes": np.int64, "copies": np.int64, "codes": np.int8, "bounds": np.float64, "vectors": np.float64 if wide else np.float32}
    out = {k: np.frombuffer(group[k][row].as_py(), dtype=t) for k, t in types.items()}
    return out | {"codes": out["codes"].reshape(-1, dim), "bounds": out["bounds"].reshape(3, -1), "vectors": out["vectors"].reshape(-1, dim)}


def _linked(left: dict, right: dict, threshold: float) -> np.ndarray:
    """Boolean matrix: is the cosine of this pair at least the threshold?"""
    exact = np.float32 if 127 * 127 * left["codes"].shape[1] < 1 << 24 else np.float64  # whole sums stay exact
    product = (left["codes"].astype(exact) @ right["codes"].astype(exact).T).astype(np.float64)
    scale_l, code_l, error_l = left["bounds"]
    scale_r, _, error_r = right["bounds"]
    product *= scale_l[:, None]
    product *= scale_r[None, :]
    bound = code_l[:, None] * error_r[None, :] + (error_l[:, None] + _SLACK)
    linked = product - bound >= threshold
    rows, cols = np.nonzero((product + bound >= threshold) & ~linked)
    for start in range(0, len(rows), 1 << 16):
        i, j = rows[start : start + (1 << 16)], cols[start : start + (1 << 16)]
        linked[i, j] = _cosine(left["vectors"][i], right["vectors"][j]) >= threshold
    return linked


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x.astype(np.float64), y.astype(np.float64)
    dot = np.einsum("ij,ij->i", x, y)
    return dot / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def _roots(linked: np.ndarray, bipartite: bool = False) -> np.ndarray:
    """For each vector, the index of the first vector of its group within this task."""
    n, m = linked.shape
    total = n + m if bipartite else n
    root = np.full(total, -1)
    for seed in range(n):
        if root[seed] >= 0 or not linked[seed].any():
            continue
        edge = np.array([seed])
        root[seed] = seed
        while len(edge):
            if bipartite:
                rows, cols = edge[edge < n], edge[edge >= n] - n
                near = np.concatenate([linked[:, cols].any(axis=1), linked[rows].any(axis=0)])
            else:
                near = linked[edge].any(axis=0)
            edge = np.flatnonzero(near & (root < 0))
            root[edge] = seed
    root[root < 0] = np.flatnonzero(root < 0)
    return root


def bound_holds(x: np.ndarray, y: np.ndarray) -> bool:
    """For tests: the int8 product of two vectors lies within its stated bound of their cosine."""
    group = pa.table({"dim": pa.array([len(x)] * 2, pa.int32()), "v": [x.tolist(), y.tolist()], "label": [0, 0], "tile": [0, 0], "tiles": [1, 1], "node": [0, 1], "copies": [1, 1]})
    tile = _unpack(_pack(group), 0, len(x))
    scale, code, error = tile["bounds"]
    q = tile["codes"].astype(np.int64)
    product = float(q[0] @ q[1]) * scale[0] * scale[1]
    cosine = float(_cosine(tile["vectors"][:1], tile["vectors"][1:])[0])
    return math.fabs(product - cosine) <= code[0] * error[1] + error[0] + _SLACK
