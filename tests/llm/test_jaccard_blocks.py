"""Blocks of the Jaccard join stay in proportion to the input."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
from brute import groups, jaccard, order
from pyspark.sql import functions as F

from tallyfold.llm import jaccard as J
from tallyfold.llm.tables import text_key


def test_parities_connect_what_all_pairs_connect():
    draw = random.Random(4)
    for turn in range(20):
        sets = []
        for size in (5, 30, 120, 250, 260, 700, 1100):
            base = [draw.getrandbits(63) for _ in range(size)]
            for _ in range(4):
                kept = set(base) - set(draw.sample(base, draw.randint(0, size // 6)))
                sets.append(np.array(sorted(kept | {draw.getrandbits(63) for _ in range(draw.randint(0, size // 12))}), dtype=np.uint64))
        side = np.array([draw.randrange(2) for _ in sets]) if turn % 2 else None
        size = np.array([len(s) for s in sets])
        found = J.near_by_parities(size, [J.parities(s) for s in sets], 80, side)
        similar = [(i, j) for i in range(len(sets)) for j in range(i) if (side is None or side[i] != side[j]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        root = groups(len(sets), found)
        assert similar and all(root[i] == root[j] for i, j in similar)
        assert all(i // 4 == j // 4 for i, j in found if min(size[i], size[j]) > 20)  # sets of different bases are told apart


def test_large_blocks_send_texts_of_similar_sets_alone(spark):
    """A block chained by chance, of which three texts are similar: 2 of 60, or 60 texts in 8 chunks before."""
    draw = random.Random(6)
    texts = [" ".join(f"w{draw.randrange(5000)}" for _ in range(40)) for _ in range(60)]
    texts[1], texts[2] = texts[0] + " more", "more " + texts[0]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("crc", text_key(F.col("text")))
    members = rows.select(F.col("doc_id").alias("node"), "doc_id", "crc", F.lit(7).cast("long").alias("block")).repartition(3)
    refined = J._refined(rows, members, 5, 80, 8)
    assert {r.node for r in refined.collect()} == {0, 1, 2} and refined.select("block").distinct().count() == 1
    assert J._refined(rows, members, 5, 80, 100).count() == 60  # a block that fits a task is searched as it is


def test_a_block_of_many_chained_texts_against_brute_force(spark):
    draw = random.Random(9)
    line = "one line that all of these texts hold somewhere"
    texts = [line + " " + " ".join(f"v{draw.randrange(300)}" for _ in range(draw.randint(6, 30))) for _ in range(60)]
    texts += [t + " tail" for t in texts[:20]] + texts[:5]
    rows = list(enumerate(texts))
    out = J.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), chunk=4).collect()
    assert order([(r.doc_id, r.n_shingles, r.component_id) for r in out]) == order(jaccard(rows))


def test_parts_are_packed():
    """Parts take 10 bytes or less each (36 as rows before), and name the sets that share them."""
    draw = np.random.default_rng(3)
    batches, shared, size, count = [], {}, 0, 0
    for _ in range(3):
        ids = np.unique(draw.integers(0, 1 << 63, 3000, dtype=np.uint64))
        part = np.concatenate([draw.integers(0, 1 << 63, 60_000, dtype=np.uint64) * np.uint64(2), np.arange(40, dtype=np.uint64) << np.uint64(57)])
        owner = draw.integers(0, len(ids), len(part))
        batches.append(J._dealt(part.copy(), owner.copy(), ids, 6))
        size, count = size + sum(len(b or b"") for k in ("part", "low", "high") for b in batches[-1].column(k).to_pylist()), count + len(part)
        for p, o in zip(part.tolist(), owner.tolist()):
            shared.setdefault(p, set()).add(int(ids[o]))
    assert size <= 10 * count
    table = pa.Table.from_batches(batches)
    found = pa.concat_tables([J._shared(6)((pa.scalar(k),), table.filter(pa.compute.equal(table["bucket"], k))) for k in range(64)]).to_pylist()
    name = {r["a"]: np.int64(r["b"]).view(np.uint64).item() for r in found if r["named"]}
    every = sorted(set(name.values()))
    at = {x: i for i, x in enumerate(every)}
    got = groups(len(every), [(at[name[r["a"]]], at[name[r["b"]]]) for r in found if not r["named"]])
    assert got == groups(len(every), [(at[min(s)], at[x]) for s in shared.values() for x in s])


def test_small_blocks_send_texts_of_similar_sets_alone(spark, monkeypatch):
    """Pairs that share a line by chance are in one block, of which no text is sent: 86 texts before."""
    draw = random.Random(12)
    words = lambda n: " ".join(f"u{draw.randrange(10**6)}" for _ in range(n))
    texts = [f"{line} {words(n)}" for line in (words(30) for _ in range(40)) for n in (25, 30)]
    texts += [t + " tail" for t in texts[:6]]
    searched = []
    monkeypatch.setattr(J, "_search_blocks", lambda rows, members, *rest, search=J._search_blocks: searched.append(members.count()) or search(rows, members, *rest))
    rows = list(enumerate(texts))
    out = J.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert order([(r.doc_id, r.n_shingles, r.component_id) for r in out]) == order(jaccard(rows))
    assert searched == [12]


def test_sets_at_the_ends_of_size_classes_are_told_apart_by_no_rounding(spark):
    """A set of 4 m shingles inside one of 5 m: a similarity of 0.8, wherever classes of sizes end."""
    texts = [" ".join(f"m{m}x{k}" for k in range(size * m + 4)) for m in range(1, 90) for size in (4, 5)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("crc", text_key(F.col("text")))
    members = rows.select(F.col("doc_id").alias("node"), "doc_id", "crc", F.lit(7).cast("long").alias("block")).repartition(3)
    found = {r.node: r.block for r in J._refined(rows, members, 5, 80, 1).collect()}
    assert all(found[x] == found[x + 1] for x in range(0, len(texts), 2))


def test_components_start_from_stored_links(spark, monkeypatch):
    """Links made and contracted by one task took two Python workers, which both stay in an executor's memory."""
    plans = []
    monkeypatch.setattr(J, "components", lambda links, label, f=J.components: plans.append(links._jdf.queryExecution().executedPlan().toString()) or f(links, label))
    base = [f"one two three four five six seven eight nine ten eleven twelve {x} {x}" for x in ("a", "b", "c", "d")]
    texts = [t + tail for t in base for tail in ("", " end")]
    J.jaccard_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(plans) == 3 and not any("InArrow" in plan for plan in plans)
