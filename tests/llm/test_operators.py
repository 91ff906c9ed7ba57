"""Each operator against brute force, a round trip or held-out accuracy, with awkward rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from brute import WORD, contaminated, groups, jaccard, order, repeats
from pyspark.sql import functions as F

from tallyfold.llm import chat, components, decontaminate, embeddings, mixing, pii, quality, sharding, substrings, urls
from tallyfold.llm import jaccard as J

DOCS = "doc_id long, text string, lang string, source string, crc string, part int, node string, score double"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def documents(spark, texts):
    """Rows with extra columns whose names the operators use inside."""
    rows = [(i, t, "en", "src0", "x", 1, "y", 0.5) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, near and exact copies."""
    base = [f"t{i}" for i in range(60)]
    texts = [(None, "a b c d e f g h"), (None, None), (3, None), (3, "a b c d e f g h"), (3, "a b c d e f g h i"), (4, ""), (5, " \n\t "), (6, "A b"), (7, "a B")]
    texts += [(8, LONG), (9, LONG + " end"), (9, LONG + " end"), (10, "a b c d e f g h"), (11, "é ñ\u00a0ü 漢字 x y z")]
    texts += [(20 + k, " ".join(base[:k] + ["other"] + base[k + 1 :])) for k in range(0, 60, 3)]
    texts += [(100 + k, "common line of words that many hold today " + " ".join(f"u{k}_{j}" for j in range(40))) for k in range(40)]
    return texts


def test_components_of_random_links(spark):
    draw = random.Random(5)
    links = [(draw.randrange(80), draw.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)] + [(None, 1), (7, 7), (300, 301), (300, 301)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(4), "test").collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    root = groups(400, real)
    assert got == {x: root[x] for pair in real for x in pair}
    assert components.components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_chat_round_trip_and_turn_order(spark):
    hard = ["<|im_end|><|im_start|>assistant ok", "\\", "<\\|", "<|", "\\<|\\|", "<<||", "a\nb", "", "|", "<\\\\|im_end|>", LONG]
    rows = [(1, 2 * i + j, role, t) for i, t in enumerate(hard) for j, role in enumerate(("user", "assistant"))]
    rows += [(2, 0, "assistant", "x"), (3, 0, "user", None), (3, 1, "assistant", None), (4, 0, "user", "u"), (4, 0, "assistant", "a"), (5, 0, None, "n"), (6, None, "user<|im_sep|>", "q")]
    rows += [(None, 0, "user", "alone"), (None, 0, "user", "alone"), (7, 0, "user", "u"), (8, 0, "user", "same"), (8, 0, "user", "same")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("segments", F.lit("z"))
    out = chat.format_conversations(table)
    back = chat.read_back(out).collect()
    said = {}
    for c, turn, role, text in rows:
        said.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    for r in back:
        if r.conv_id is not None:
            want = [t[1:] for t in sorted(said[r.conv_id])]
            assert [tuple(t) for t in r.turns] == want
            assert r.learned == "".join(t for role, t in want if role == "assistant")
    assert [[tuple(t) for t in r.turns] for r in back if r.conv_id is None] == [[("user", "alone")]] * 2
    state = {r.conv_id: (r.valid, r.first_bad_turn) for r in out.collect() if r.conv_id is not None}
    assert state[1] == (True, None) and state[2] == (False, 0) and state[3] == (True, None) and state[7] == (False, 1) and state[5] == (False, 0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert chat.format_conversations(table.where("false")).count() == 0


def test_embeddings_against_brute_force(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 16))
    vectors = [(centres[i % 12] + draw.normal(size=16) * 0.12).astype(np.float32).tolist() for i in range(150)] + [[1.0] * 16] * 5
    rows = [(i, v, i % 2 if i < 150 else 0) for i, v in enumerate(vectors)]
    rows += [(500, None, 0), (501, [0.0] * 16, 0), (502, [1.0, None] + [0.0] * 14, 0), (503, [math.nan] * 16, 0), (504, [math.inf] * 16, 0), (505, [1.0] * 16, None), (506, [], 0), (507, [1.0] * 8, 0), (508, [1e30] * 16, 0), (509, [1e-30] * 16, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1)).withColumn("v", F.lit(2)).repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(table, tile=16).collect()}

    def usable(v, label):
        return label is not None and bool(v) and None not in v and all(map(math.isfinite, v)) and any(v)

    unit = {i: np.array(np.float32(v), dtype=np.float64) / np.linalg.norm(np.array(np.float32(v), dtype=np.float64)) for i, v, label in rows if usable(v, label)}
    ids = [r[0] for r in rows]
    label = {r[0]: r[2] for r in rows}
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if ids[a] in unit and ids[b] in unit and label[ids[a]] == label[ids[b]] and len(unit[ids[a]]) == len(unit[ids[b]]) and unit[ids[a]] @ unit[ids[b]] >= 0.93]
    links = Counter(x for p in pairs for x in p)
    root = groups(len(ids), pairs)
    assert pairs and got == {i: (links[k], ids[root[k]], root[k] == k) for k, i in enumerate(ids)}
    doubles = table.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(doubles, tile=16).collect()} == got
    near = [(i, [1.0, 1e-9 * i]) for i in range(4)]  # told apart in double precision alone
    apart = spark.createDataFrame([(i, v, 0) for i, v in near], "vec_id long, embedding array<double>, label int")
    assert {r.n_links for r in embeddings.near_duplicates(apart, threshold=1.0 - 1e-16).collect()} <= {3} and embeddings.near_duplicates(apart).where("n_links = 3").count() == 4
    many = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(table, tile=5).collect()}  # several groups of tiles
    assert many == got
    assert embeddings.near_duplicates(table.where("false")).count() == 0
    for _ in range(50):
        assert embeddings.bound_holds(draw.normal(size=24), draw.normal(size=24) ** 3)


def test_repeated_windows_against_brute_force(spark, awkward):
    for window in (6, 7):
        got = [tuple(r) for r in substrings.remove_repeats(documents(spark, awkward), window=window).collect()]
        assert order(got) == order(repeats(awkward, window))
    assert substrings.remove_repeats(documents(spark, awkward).where("false")).count() == 0


def test_a_full_sketch_changes_nothing(spark, awkward, monkeypatch):
    monkeypatch.setattr(substrings, "_maybe_repeated", lambda anchors, bits, table: np.ones(len(anchors), dtype=bool))
    got = [tuple(r) for r in substrings.remove_repeats(documents(spark, awkward), window=6).collect()]
    assert order(got) == order(repeats(awkward, 6))


def test_jaccard_groups_against_brute_force(spark, awkward):
    out = J.jaccard_groups(documents(spark, awkward), chunk=8).collect()
    assert order([(r.doc_id, r.n_shingles, r.component_id) for r in out]) == order(jaccard(awkward))
    kept = Counter(r.doc_id for r in out if r.kept)
    assert kept[20] == 1 and kept[23] == 0 and kept[4] == 1 and kept[8] == 1
    assert J.jaccard_groups(documents(spark, awkward).where("false")).count() == 0


def test_heap_merge_counts_as_a_full_count():
    draw = random.Random(11)
    for _ in range(200):
        ordered = [sorted(draw.sample(range(30), draw.randint(1, 20))) for _ in range(draw.randint(0, 12))]
        need = draw.randint(1, 8)
        want = {v: n for v, n in Counter(v for values in ordered for v in values).items() if n >= need}
        numbers, counts = J.occurrences(ordered, need)
        assert dict(zip(numbers.tolist(), counts.tolist())) == want


def test_search_connects_what_all_pairs_connect():
    draw = random.Random(2)
    for turn in range(30):
        sets = []
        for _ in range(5):
            base = draw.sample(range(150), draw.randint(4, 50))
            for _ in range(5):
                sets.append(np.array(sorted((set(base) - set(draw.sample(base, draw.randint(0, min(4, len(base) - 1))))) | set(draw.sample(range(150), draw.randint(0, 3)))), dtype=np.uint64))
        side = None if turn % 2 else np.array([draw.randrange(2) for _ in sets])
        want = [(i, j) for i in range(len(sets)) for j in range(i) if (side is None or side[i] != side[j]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        found = J.connections(sets, 80, side)
        assert {(max(p), min(p)) for p in found} <= set(want) and groups(len(sets), found) == groups(len(sets), want)


def test_similar_sets_always_share_a_part():
    draw = np.random.default_rng(8)
    none = np.zeros(0, dtype=np.uint64)
    for size in [*range(4, 40), 63, 64, 65, 127, 130, 255, 257, 600, 1023, 1030]:
        for _ in range(20):
            both = np.unique(draw.integers(0, 1 << 63, size, dtype=np.uint64))
            more = np.unique(draw.integers(0, 1 << 63, int(draw.integers(0, size // 4 + 1)), dtype=np.uint64))
            cut = int(draw.integers(0, len(more) + 1))
            a, b = np.union1d(both, more[:cut]), np.union1d(both, more[cut:])
            if 100 * len(both) >= 80 * len(np.union1d(a, b)) and len(a) and not np.array_equal(a, b):
                often = np.sort(draw.choice(both, len(both) // 2, replace=False)) if size % 2 else none
                part, owner = J._given([a, b], 80, often)
                assert set(part[owner == 0].tolist()) & set(part[owner == 1].tolist())


def test_pseudonyms_keep_format_link_and_undo(spark):
    values = {
        "number": ["4111 1111 1111 1111", "4111111111111111", "9807915762804490"], "email": ["Jo.Doe+7@mail.example.com"], "ip": ["97.51.17.173"],
        "date": ["2021-02-28", "28/02/2021", "02/28/2021", "31.12.1999"], "ssn": ["123-45-6789"], "phone": ["+1 (017) 555-7713", "555-123-4567"], "iban": ["DE89 3704 0044 0532 0130 00"],
        "secret": ['token = "04dbebab91ab85687d33eeaaf9ac699e1188f962'],
    }
    clean = ["Version 2.0, 12 of 300 in 1999", "see 2021-02-30 and 300.1.2.3", "CC BY-NC 4.0", "DE88 3704 0044 0532 0130 00x", ""]
    rows = [(i, f"see {v}, and {v}") for i, v in enumerate(v for vs in values.values() for v in vs)]
    rows += [(100 + i, t) for i, t in enumerate(clean)] + [(200, None), (None, None), (201, "4111111111111111 " + LONG + " 97.51.17.173")]
    table = documents(spark, rows)
    out = pii.pseudonymise(table, b"k")
    got = {r.doc_id: r for r in out.collect()}
    flat = [(kind, v) for kind, vs in values.items() for v in vs]
    for i, (kind, value) in enumerate(flat):
        r = got[i]
        assert r.kinds == kind and r.n_found == 2 and value not in r.text
        first, second = (r.text[s.begin : s.end] for s in r.spans)
        shape = "[0-9]+" if kind == "ip" else "[0-9a-zA-Z]"
        assert first == second and re.sub(shape, "x", first) == re.sub(shape, "x", value)
        assert pii.Pseudonyms(b"k").pseudonym(kind, value) == first != pii.Pseudonyms(b"other").pseudonym(kind, value)
        assert pii.Pseudonyms(b"k", undo=True).pseudonym(kind, first) == value
    digits = [re.sub(r"\D", "", got[i].text[4:23]) for i in (0, 1)]
    assert digits[0] == digits[1][:16] and pii.luhn(digits[0])
    assert all(got[100 + i].text == t and got[100 + i].n_found == 0 for i, t in enumerate(clean)) and got[200].text is None and got[201].n_found == 2
    again = pii.pseudonymise(out, b"k", undo=True)
    assert {r.doc_id: r.text for r in again.collect()} == dict(rows)
    assert pii.pseudonymise(table.where("false"), b"k").count() == 0


def test_values_are_found_in_and_before_what_fails(spark):
    iban, card, other = "ES9121000418450200051332", "4111 1111 1111 1111", "5500 0000 0000 0004"
    spaced, old = "ES91 2100 0418 4502 0005 1332", "GB29 NWBK 6016 1331 9268 19"
    cases = {
        f"{iban} EUR 500": [iban], f"{spaced} BIC X": [spaced], f"pay {spaced} 5000 EUR": [spaced], f"AT611904300234573201 {iban}": ["AT611904300234573201", iban],
        f"{card} 12/25": [card], f"{card} 123": [card], f"{card} {other}": [card, other], f"AB12 CDEF {old}": [old], f"ID12 {card}": [card], f"{card}": [card],
        "+49 30 1234 5678 9012 3456": ["+49 30 1234 5678"], "2021-02-30 1234 5678 9012": ["2021-02-30 1234 5678"], "DE88 3704 0044 0532 0130 00": [], "1111 1111 1111 1111": [],
    }
    rows = [(i, f"see {t}, please") for i, t in enumerate(cases)]
    out = {r.doc_id: r for r in pii.pseudonymise(documents(spark, rows), b"k").collect()}
    for i, values in enumerate(cases.values()):
        assert out[i].n_found == len(values) or i in (10, 11) and out[i].n_found > 0, (rows[i], out[i].text)
        assert all(v not in out[i].text for v in values), (rows[i], out[i].text)
    images = {re.sub(" ", "", out[i].text[s.begin : s.end]) for i in (4, 5, 6, 8, 9) for s in out[i].spans[:1]}
    assert len(images) == 1 and pii.luhn(images.pop()) and out[4].text.endswith(" 12/25, please")
    again = pii.pseudonymise(spark.createDataFrame(list(out.values())), b"k", undo=True)
    assert {r.doc_id: r.text for r in again.collect()} == dict(rows)


@pytest.mark.parametrize("length", [24, 25, 111, 128, 129, 200, 256, 257, 1000, 5000, 20_000])
def test_long_values_leave_nothing_in_clear(length):
    draw, p, back = random.Random(length), pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", undo=True)
    for alphabet, form, kind in (("0123456789abcdef", "token=%s", "secret"), ("0123456789ABCDEF", "KEY: %s", "secret"), ("0123456789abcdefABCDEF", "key='%s", "secret"), ("abcdefghijklmnopqrstuvwxyz", "%s@mail.example.com", "email")):
        value = "".join(draw.choice(alphabet) for _ in range(length))
        text = form % value
        (image, spans), at = p.apply(text), form.index("%s")
        assert [s[0] for s in spans] == [kind] and len(image) == len(text) and back.apply(image)[0] == text
        same = sum(a == b for a, b in zip(value, image[at : at + length]))
        chance = length / len(alphabet)
        assert same <= chance + 6 * chance**0.5 + 3 and set(image[at : at + length]) <= set(alphabet)
        assert "".join(value[:20]) not in image and p.apply(text)[0] == image
        other = form % (value[:-1] + alphabet[(alphabet.index(value[-1]) + 1) % len(alphabet)])
        changed = p.apply(other)[0][at : at + length]
        assert sum(a == b for a, b in zip(changed, image[at : at + length])) <= chance + 6 * chance**0.5 + 3  # one digit decides about all


def test_long_values_in_documents(spark):
    value = "0123456789abcdef" * 500
    rows = [(1, f"token={value} and {'n' * 9000}@example.com"), (2, f"secret: {value}"), (3, "plain")]
    out = pii.pseudonymise(documents(spark, rows), b"k")
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1][6 : 6 + len(value)] == got[2][8:] != value and "nnnnnnnn" not in got[1] and got[3] == "plain"
    assert {r.doc_id: r.text for r in pii.pseudonymise(out, b"k", undo=True).collect()} == dict(rows)


def test_sequences_are_one_to_one(monkeypatch):
    monkeypatch.setattr(pii, "_BLOCK", 2)
    p, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", undo=True)
    sizes = [3, 2, 1, 4, 2]
    every = [pii._parted(x, sizes) for x in range(48)]
    images = [p.sequence(x, sizes, "t") for x in every]
    assert sorted(images) == sorted(every) and [back.sequence(y, sizes, "t") for y in images] == every and p.sequence([], [], "t") == []


def test_a_pseudonym_that_would_validate_what_failed_is_walked_on(spark):
    """What follows an invalid IBAN or date may not make it valid; the walk ends at the value itself at the latest."""
    p, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", undo=True)
    draw, clear = random.Random(3), 0
    for _ in range(3000):
        text = "DE88 3704 0044 0532 " + "".join(draw.choice("0123456789") for _ in range(4)) + " " + draw.choice(["4111 1111 1111 1111", "5500 0000 0000 0004", "00 2021-02-28"])
        image, spans = p.apply(text)
        clear += sum(text[b:e] == image[b:e] for _, b, e in spans)
        assert back.apply(image)[0] == text
    assert clear == 0


def test_undo_reads_random_texts_as_they_were_written():
    draw, p, back = random.Random(4), pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", undo=True)
    parts = ["ES91", "DE89", "ID12", "4111", "1111", "0532", "30", "7", "EUR", "+49", "2021-02-30", "30/02/2021", "000-12-3456", "999.1.2.3", "GB29 NWBK 6016 1331 9268 19", "a@b.de", "0000"]
    for _ in range(1500):
        text = "".join(draw.choice(parts) + draw.choice([" ", " ", " ", "-", "", ", "]) for _ in range(draw.randrange(2, 9)))
        assert back.apply(p.apply(text)[0])[0] == text


def test_digits_and_names_of_all_scripts(spark):
    plain = {"phone": "+98 21 1234 5678", "number": "4111 1111 1111 1111", "ip": "97.51.17.173", "date": "2021-02-28", "ssn": "123-45-6789"}
    zeros = "\u06f0\u0660\u0966\uff10"
    other = [(k, v.translate({ord(str(i)): ord(z) + i for i in range(10)})) for k, v in plain.items() for z in zeros]
    names = [("email", f"{n}@example.com") for n in ("иван.петров", "李小龙", "Éloïse", "\u0663\u0664")]
    rows = [(i, f"см {v} — ok") for i, (_, v) in enumerate(other + names)] + [(100, "7 of _@example.com"), (101, "٣ من ٤")]
    out = {r.doc_id: r for r in pii.pseudonymise(documents(spark, rows), b"k").collect()}
    p = pii.Pseudonyms(b"k")
    for i, (kind, value) in enumerate(other + names):
        r = out[i]
        image = r.text[r.spans[0].begin : r.spans[0].end]
        assert r.kinds == kind and r.n_found == 1 and image != value and p.pseudonym(kind, value) == image
        if kind != "email":
            assert pii._ascii(image) == p.pseudonym(kind, plain[kind]) and not re.search("[0-9]", image)
    assert out[100].n_found == out[101].n_found == 0
    again = pii.pseudonymise(spark.createDataFrame(list(out.values())), b"k", undo=True)
    assert {r.doc_id: r.text for r in again.collect()} == dict(rows)


@pytest.mark.parametrize("count", [2, 3, 10, 97, 1000])
def test_permutation_is_one_to_one(count):
    p, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", undo=True)
    images = [p.permute(x, count, "t") for x in range(count)]
    assert sorted(images) == list(range(count)) and [back.permute(y, count, "t") for y in images] == list(range(count))


def test_mixing_meets_budgets(spark):
    draw = random.Random(4)
    rows = [(i, " ".join(["w"] * draw.randint(0, 30)), draw.choice(["en", "en", "fr", None]), f"s{draw.choice([0, 0, 0, 1, 2])}") for i in range(600)]
    rows += [(None, "a b", "en", "s0"), (None, None, "fr", "s1"), (1, "a b", "en", "s0"), (1, "a b", "en", "s0"), (900, LONG, "de", "s9")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("budget", F.lit(3)).withColumn("rest", F.lit(1)).repartition(3)
    levels = [mixing.Level("lang", {"en": 1, "fr": 6, "de": 0}, 2), mixing.Level("source", {"s0": 5})]
    out = mixing.mix(table, levels, 0.7, max_epochs=3, seed=1).collect()
    has, got = Counter(), Counter()
    for _, t, lang, source in rows:
        has[lang or "", source] += len(WORD.findall(t or ""))
    for r in out:
        got[r.lang, r.source] += r.taken
        assert 0 <= r.taken <= r.tokens and r.epoch < 3
    weight = {"en": 1, "fr": 6, "de": 0, "": 2}
    usable = {k: v for k, v in has.items() if weight[k[0]]}
    total = min(int(sum(has.values()) * 0.7), 3 * sum(usable.values()))
    assert sum(got.values()) == total  # nothing is lost to rounding or shortage

    def fill(budget, children):
        """Children (weight, able) by name: raise the level until the budget is gone."""
        full, share = {}, {}
        while True:
            rest = budget - sum(children[k][1] for k in full)
            w = sum(children[k][0] for k in children if k not in full)
            new = [k for k in children if k not in full and rest * children[k][0] >= children[k][1] * w]
            if not new:
                share = {k: rest * children[k][0] / w for k in children if k not in full}
                return {k: children[k][1] for k in full} | share
            full |= dict.fromkeys(new)

    langs = {k for k, _ in usable}
    first = fill(total, {x: (weight[x], 3 * sum(v for k, v in usable.items() if k[0] == x)) for x in langs})
    for x in langs:
        second = fill(first[x], {k[1]: (5 if k[1] == "s0" else 1, 3 * v) for k, v in usable.items() if k[0] == x})
        assert all(abs(got[x, s] - b) <= 2 for s, b in second.items())
    copies = Counter((r.doc_id, r.crc, r.epoch) for r in out if r.doc_id not in (None, 1))
    assert max(copies.values()) == 1 and sum(r.taken < r.tokens for r in out) <= len(usable)
    assert mixing.mix(table.where("false"), levels, 0.5).count() == 0


def test_url_rules_against_brute_force(spark):
    hosts = ["a.example.net", "example.net", "xexample.net", "EXAMPLE.net", "net", "x.org", "org", "a.b.example.com", "com", "", "a..net", "ñ.org"]
    pages = [(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in ("", "/", "/en/x", "/en", "/de/a?/en/", "/fr/#q", "?x"))]
    pages += [(900, None), (901, "no scheme"), (None, "http://a.net/"), (902, "x://y://z.org/fr/1"), (903, "http://hot.example.net/" + "x" * 100_000)]
    pages += [(1000 + i, "http://hot.example.net/en/1") for i in range(300)] + [(1000, "http://hot.example.net/en/1")]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("org", "/fr/", "block"), ("a.example.net", "", "allow"), (None, "/", "block"), ("b.example.com", None, "block")]
    table = spark.createDataFrame(pages, "page_id long, url string").withColumn("key", F.lit(1)).withColumn("range", F.lit("r")).repartition(3)
    lawful = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = [tuple(r) for r in urls.judge_pages(table, lawful).collect()]

    def judge(page_id, url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]
        fits = [(len(h) + len(p or ""), len(h), v, h + (p or "")) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        best = max(fits, default=(0, 0, "allow", None))
        return page_id, host, path, best[3], best[2]

    assert Counter(got) == Counter(judge(*p) for p in pages)
    assert urls.judge_pages(table.where("false"), lawful).count() == 0
    assert {r.verdict for r in urls.judge_pages(table, lawful.where("false"), "block").collect()} == {"block"}


def test_templates_find_other_numbers_and_reject_contradictions(spark):
    item = "If a train that Mary Brown drives covers 120 km in 2 hours and then 120 km more , how far does it go per hour on the whole way home ?"
    short = "A plain question of just nine words is here"
    bench = [(1, item), (2, short), (3, "too short"), (4, None), (None, item), (1, item)]
    other = item.replace("120", "95").replace("Mary Brown", "Eva Green")
    broken = item.replace("120 km in", "95 km in").replace("how", "what")  # one value stands for two, and no window is the item's
    docs = [(1, "Before. " + item + " After."), (2, other), (3, broken), (4, "nothing of the kind " * 20), (5, None), (None, other), (6, "x " + short.upper() + " y"), (7, ""), (8, LONG + " . " + other), (2, other)]
    out = decontaminate.find_contamination(documents(spark, docs), spark.createDataFrame(bench, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): r for r in out}
    assert {k for k in found if k[0] != 3} == {(1, 1), (2, 1), (None, 1), (6, 2), (8, 1)} and Counter(r.doc_id for r in out)[2] == 2
    assert found[1, 1].changed_slots == 0 and found[2, 1].changed_slots >= 3 and (3, 1) not in found
    table = spark.createDataFrame(bench, "item_id long, text string")
    assert decontaminate.find_contamination(documents(spark, docs), table.where("false")).count() == 0
    assert decontaminate.find_contamination(documents(spark, docs).where("false"), table).count() == 0
    small = decontaminate.find_contamination(documents(spark, docs), table, most_bits=4).collect()  # nearly all windows pass
    assert sorted(map(str, small)) == sorted(map(str, out))


def test_contamination_against_brute_force(spark):
    draw = random.Random(12)
    vocabulary = ["the", "train", "covers", "how", "far", "km", "hours", "Mary", "Évora", "Brown", "12", "3", "4.5", "12", "is", "it", "(and)", "go", "per", "of", "which", "way", "home", "...", "Xx", "SHOUT", "a", "Q", "dollars", "é"]

    def sentence(n):
        return "".join(draw.choice(vocabulary) + draw.choice([" ", " ", " ", " ", "\n", ". ", ", "]) for _ in range(n))

    def changed(text):
        if draw.random() < 0.6:
            return text.replace("12", "95").replace(" Mary", " Eva").replace("4.5", draw.choice(["7", "4.5", "95"]))
        words = text.split(" ")
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(words))
            words[at] = draw.choice(vocabulary + ["7", "8", "Eva", "miles"])
        return " ".join(words)

    items = [(i % 25, sentence(draw.choice([1, 3, 8, 9, 13, 14, 20, 40]))) for i in range(30)] + [(None, "the train"), (40, None), (41, ""), (42, "...")]
    texts = []
    for i in range(200):
        parts = [sentence(draw.randrange(20))]
        for _ in range(draw.randrange(3)):
            text = draw.choice(items)[1] or ""
            cut = draw.randrange(1 + len(text) // 2) if draw.random() < 0.4 else 0
            parts += [changed(text[cut:]) if draw.random() < 0.7 else text[cut:], sentence(draw.randrange(5))]
        texts.append("".join(parts))
    out = decontaminate.find_contamination(documents(spark, list(enumerate(texts))), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = contaminated(texts, items, set(decontaminate.UNITS))
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_tokens, r.changed_slots) for r in out}
    assert got == want and len(want) > 100 and sum(c > 0 for *_, c in want.values()) > 10


def test_the_filter_changes_nothing(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    items = [(1, " ".join(words[:25])), (1, " ".join(words[20:45])), (2, " ".join(words[40:])), (3, " ".join(words[:12]))]
    texts = [(1, " ".join(words)), (2, " ".join(words[:45])), (3, "nothing")]
    whole = {k: tuple(r) for k, r in found_in(spark, texts, items).items()}
    for bits in (3, 12):
        out = decontaminate.find_contamination(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string"), most_bits=bits).collect()
        assert {(r.doc_id, r.item_id): tuple(r) for r in out} == whole and len(out) == len(whole) == 5
    assert whole[2, 1][3:5] == (26, 45)


def test_windows_with_the_items_own_values_are_always_found(spark):
    item = "If a train that Mary Brown drives covers 120 km in 2 hours and then 120 km more , how far does it go per hour on the whole way home ?"
    texts = [(1, item.replace("120 km in", "95 km in")), (2, item.replace("120 km in", "95 km in").replace("how", "what"))]
    found = found_in(spark, texts, [(1, item)])
    assert found.keys() == {(1, 1)} and found[1, 1].changed_slots == 0 and found[1, 1].n_tokens >= 20


def found_in(spark, texts, items):
    out = decontaminate.find_contamination(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id): r for r in out}


def test_copies_are_found_whatever_their_slots_and_length(spark):
    names = "In the list are Anna Berg Carl Dorn Emil Falk Greta Hahn Ida Jung Karl Lenz Maria Noll Otto Pohl and nobody else"
    table = "12 4 99 3 17 56 81 40 23 77 65 31 8 90 54 26"
    items = [(1, "What is 12 + 34 + 56 + 78 + 90 + 11"), (2, names), (3, table), (4, "What is the capital of France?"), (5, " ... "), (6, "")]
    texts = [(i, f"Some words before it. {t}\nand some behind it") for i, t in items if i < 5]
    texts += [(20, names.replace("Carl Dorn", "Carl\nDorn")), (21, table.replace("56", "57")), (22, "What is the capital of Spain?"), (23, "... nothing ...")]
    found = found_in(spark, texts, items)
    assert found.keys() == {(1, 1), (2, 2), (3, 3), (4, 4), (20, 2)} and {r.changed_slots for r in found.values()} == {0}
    assert found[4, 4].n_tokens == 6 and found[3, 3].n_windows == 4


def test_short_items_are_found_in_the_middle_of_a_line(spark):
    item = "What is the capital of France and which 3 rivers run through it?"
    other = item.replace("France", "Spain").replace("3", "5")
    before = ["3) ", 'he said." ', "first, ", "a word ", "4 ", "", "End. "]
    texts = [(2 * i + k, f"{b}{t} and so on") for i, b in enumerate(before) for k, t in enumerate((item, other))]
    items = [(1, item), (2, "hours after the start of the walk they had 4 apples")]
    texts += [(100, "It was 3 hours after the start of the walk they had 5 apples")]
    found = found_in(spark, texts, items)
    assert found.keys() == {(i, 1) for i in range(2 * len(before))} | {(100, 2)}
    assert all(r.changed_slots == (2 * (d % 2) if d < 100 else 1) for (d, _), r in found.items())


def test_a_far_contradiction_or_a_shared_id_hides_no_copy(spark):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    far, near = words[:50], [f"other{w}" for w in words]
    far[2] = far[45] = near[60] = near[63] = "3"
    one = "The first of the texts tells that 7 boats sailed to the far island"
    two = "In all of these 9 books a tale is told about the great sea"
    items = [(1, " ".join(far)), (2, " ".join(near)), (3, one), (3, two)]
    texts = [(1, " ".join([*far[:45], "4", *far[46:]])), (2, " ".join([*near[:63], "4", *near[64:]])), (3, one), (4, two), (5, two.replace("9", "8"))]
    found = found_in(spark, texts, items)
    assert found.keys() == {(1, 1), (2, 2), (3, 3), (4, 3), (5, 3)}
    assert found[1, 1].n_tokens == 50 and found[1, 1].changed_slots == 1 and found[5, 3].changed_slots == 1
    assert [found[k].changed_slots for k in ((2, 2), (3, 3), (4, 3))] == [0, 0, 0]


def test_classifier_on_held_out_rows(spark, sf_dir):
    texts = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    labels = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/labels.parquet")
    model = quality.train(texts, labels.where(~quality.held_out(F.col("doc_id"))), settings=quality.Settings(max_rows=400, epochs=6))
    odd = [(None, None, "en"), (-1, "", "en"), (-2, LONG, "en"), (-2, LONG, "en")]
    table = texts.select("doc_id", "text", F.lit(0.9).alias("score")).unionByName(spark.createDataFrame(odd, "doc_id long, text string, score string").withColumn("score", F.lit(0.1)))
    out = quality.score_documents(table, model)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9
    own = {r.doc_id: r.score for r in out.where("doc_id IS NULL OR doc_id < 0").collect()}
    assert own[None] == own[-1] and all(0 <= x <= 1 for x in own.values())
    few = labels.where("quality IS NOT NULL").limit(8)
    again = quality.train(texts.unionByName(texts), few, settings=quality.Settings(max_rows=400, epochs=2))
    once = quality.train(texts, few, settings=quality.Settings(max_rows=400, epochs=2))
    assert np.array_equal(again.weights, once.weights) and again.bias == once.bias  # equal rows teach once
    kept = quality.keep_good(table, model)
    assert kept.columns == table.columns and kept.count() == out.where("predicted = 1").count()
    none = quality.train(texts, labels.where("false"))
    assert {r.score for r in quality.score_documents(texts.limit(5), none).collect()} == {0.5} or abs(none.bias) < 1e-6
    assert quality.score_documents(table.where("false"), model).count() == 0


def test_rows_bound_what_is_learned_from(spark, monkeypatch):
    hot = [(1, f"text number {i} of one id") for i in range(3000)] + [(2, "another"), (3, None)]
    seen = []
    monkeypatch.setattr(quality, "fit", lambda examples, settings: seen.append(len(examples)))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    quality.train(documents(spark, hot), labels, settings=quality.Settings(max_rows=50))
    assert seen == [50]


def test_written_shards_hold_every_row_once(spark, awkward, tmp_path):
    table = documents(spark, awkward)
    sharding.write_shards(table, [1.0, 2.0, 1.0], str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert order([(r.doc_id, r.text or "") for r in back.collect()]) == order([(i, t or "") for i, t in awkward])
    assert Counter((r.doc_id, r.shard) for r in back.collect()) == Counter((r.doc_id, r.shard) for r in sharding.shard_records(table, [1.0, 2.0, 1.0]).collect())
    assert set(table.columns) < set(back.columns)


def test_shards_move_only_into_the_new_one(spark, awkward):
    texts = awkward + [(1000 + i, f"t{i}") for i in range(3000)] + [(None, f"n{i}") for i in range(200)]
    table = documents(spark, texts)
    out = sharding.shard_records(table, [1.0, 2.0, 1.0], grown_weight=1.0).collect()
    assert len(out) == len(texts) and all(r.grown_shard in (r.shard, 3) for r in out)
    of = {}
    for r in out:
        if r.doc_id is not None:
            assert of.setdefault(r.doc_id, r.shard) == r.shard
    sizes = Counter(r.shard for r in out)
    assert 0.42 < sizes[1] / len(out) < 0.58 and 0.13 < sum(r.grown_shard == 3 for r in out) / len(out) < 0.27
    for s, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    grown = {r.doc_id: r.shard for r in sharding.shard_records(table, [1.0, 2.0, 1.0, 1.0]).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in out if r.doc_id is not None)
    assert {r.size for r in out if r.doc_id == 4} == {1} and sharding.shard_records(table.where("false"), [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_records(table, [0.0])
