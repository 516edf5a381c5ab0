"""Every training-data operator against brute force and on odd inputs."""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from emberframe.llm import decontam, language, line_dedup, lm_score, mixing, neighbours, quality, simhash, tally, toxicity, training_order
from emberframe.llm import words as word_hashing
from emberframe.llm.common import Texts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, keep string, slot int, block int, size string, row int"
SHARED = "this line is found in so many documents that all copies but one have to go"


def docs(spark, rows):
    """Rows (doc_id, text, lang, source), with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, l, s, 0, 0.5, "x", "y", 1, 2, "z", 3) for i, t, l, s in rows], DOCS).repartition(3)


def words(seed: int, n: int) -> list[str]:
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(words(1, 30_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (None, "no id here", "en", None), (3, "   \n\t ", "fr", "b"), (4, long, "en", "a"), (5, "Été à la plage, là-bas", "fr", "b"), (6, "same", "en", "a"), (6, "same", "en", "a"), (6, "other text", "en", "a"), (7, "1234 !!", None, "c")]
    return docs(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


# Every operator on odd and on empty tables: one defined row for each input row.
def test_odd_rows(spark, odd, none):
    marks = labels(spark, [(1, 1, 0), (2, 0, 1), (4, None, None), (None, 1, 1), (6, 1, 0), (6, 0, 1)])
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "short item")], "item_id long, text string")
    for table, n in ((odd, 10), (none, 0)):
        assert language.predictions(table).count() == n
        assert line_dedup.digest(table).count() == n
        assert simhash.near_duplicates(table).count() == n
        assert quality.predictions(table, marks).count() == n
        assert toxicity.predictions(table, marks).count() == n
        assert mixing.mix(table).count() == n
        assert lm_score.scores(table, marks).count() == n
        assert decontam.overlaps(table, bench).count() == 0
        assert decontam.decontaminated(table, bench).count() == n
        assert decontam.decontaminated(table, bench).columns == table.columns
    assert training_order.shards(none).count() == 0
    for r in quality.predictions(odd, marks).collect() + toxicity.predictions(odd, marks).collect():
        assert 0 <= r.score <= 1


def test_language_by_held_out_rows(spark):
    a, b = words(3, 40), [w.translate(str.maketrans("abcdefghij", "mnopqrstuv")) for w in words(4, 40)]
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(a if i % 2 else b, 30)), "aa" if i % 2 else "bb", "s") for i in range(200)]
    got = {r.doc_id: r for r in language.predictions(docs(spark, [*rows, (900, None, "aa", "s"), (901, "123 !", "aa", "s")])).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert len(held) > 20 and np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.95
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0


def test_language_gradients():
    rng = np.random.default_rng(1)
    net = language.Network(["a", "b", "c"])
    x, y, w = rng.integers(0, 256, (9, 5)).astype(np.uint8), rng.integers(0, 3, 5), np.full(5, 0.2)
    for p in net.parameters():
        p[...] = p.astype(np.float32)
    _, grads = net.gradients(x, y, w)
    for p, g in zip(net.parameters(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before, eps = p[at], 1e-2
        p[at] = before + eps
        up, _ = net.gradients(x, y, w)
        p[at] = before - eps
        down, _ = net.gradients(x, y, w)
        p[at] = before
        assert abs((up - down) / (2 * eps) - g[at]) < 0.05 * abs(g[at]) + 2e-3


def test_neighbours_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16)) + rng.normal(size=(6, 16))[rng.integers(0, 6, 900)] * 3
    x[100:400] = x[100]  # many copies
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(900)]
    rows += [(2000, None, 0), (2100, [0.0] * 16, 0), (2200, [float("nan")] * 16, 0), (2300, [None, *[1.0] * 15], 0), (2400, [float("inf"), *[1.0] * 15], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int").repartition(4)
    got = neighbours.search(df, F.col("id") % 100 == 0).collect()
    assert {r.query_id for r in got} == set(range(0, 900, 100))
    hits = 0
    for q in range(0, 900, 100):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11))
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        true = [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        hits += len({r.vec_id for r in mine} & set(true))
        assert all(abs(r.score - d[r.vec_id]) < 1e-12 for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
    assert hits >= 0.9 * 90
    monkeypatch.setattr(neighbours, "CHUNK", 2)  # queries of a block in several tasks
    assert {(r.query_id, r.rank, r.vec_id) for r in neighbours.search(df, F.col("id") % 100 == 0).collect()} == {(r.query_id, r.rank, r.vec_id) for r in got}
    twice = neighbours.search(df.unionByName(df.where("vec_id = 200 or vec_id = 7")), F.col("id") % 100 == 0).collect()
    assert not any(r.query_id == r.vec_id for r in twice) and {r.rank for r in twice if r.query_id == 200} == set(range(1, 11))
    few = neighbours.search(df.where("vec_id < 4"), F.col("id") % 100 == 0).collect()
    assert [r.rank for r in sorted(few, key=lambda r: r.rank)] == [1, 2, 3]
    assert neighbours.search(df.where("vec_id < 0"), F.col("id") % 100 == 0).count() == 0


def test_training_order_round_trip(spark, tmp_path, odd):
    rows = [(i, " ".join(words(i, i % 50 * 9)), "en", "s") for i in range(300)]
    table = docs(spark, rows).unionByName(odd)
    out = str(tmp_path / "shards")
    training_order.shards(table, stride=64, slots=128).write.parquet(out)
    back, slots = {}, []
    for slot, doc, part, ids in training_order.read_from(spark, out, 0, 64, 128):
        slots.append(slot)
        back.setdefault(doc, []).append((part, bytes(ids)))
    assert slots == list(range(len(slots)))
    for i, t, *_ in rows:
        if i not in (1, 2, 3, 4, 5, 6, 7):
            parts = sorted(back[i])
            assert [p for p, _ in parts] == list(range(len(parts)))
            assert b"".join(b for _, b in parts) == t.encode() + b"\xff"
    assert [s for s, *_ in training_order.read_from(spark, out, 200, 64, 128)] == slots[200:]
    again = str(tmp_path / "again")
    training_order.shards(table.repartition(7), stride=64, slots=128).write.parquet(again)
    key = lambda p: {r.shard: hashlib.sha256(r.payload).hexdigest() for r in spark.read.parquet(p).collect()}
    assert key(out) == key(again)
    files = training_order.write_files(spark.read.parquet(out), f"file://{tmp_path}/bin").collect()
    assert all((tmp_path / "bin" / f.file).stat().st_size == f.bytes for f in files)


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        f = training_order.Feistel(n, 5)
        s = f.slot(np.arange(n))
        assert sorted(s) == list(range(n))
        assert (f.index(s) == np.arange(n)).all()


def test_mask_hits_every_pattern():
    for gone in combinations(range(decontam.WINDOW), decontam.MISMATCHES):
        assert any(not set(gone) & {o + m for m in mask} for mask in decontam.MASKS for o in range(decontam.WINDOW - mask[-1]))


@pytest.mark.parametrize("limit", [decontam.BROADCAST_SEEDS, 0])
def test_decontamination_brute_force(spark, limit):
    item = words(50, 30)
    swapped = [w if i not in (4, 9, 17, 22) else "zzz" for i, w in enumerate(item)]
    rows = [(1, " ".join([*words(51, 40), *item, *words(52, 40)]), "en", "s"), (2, " ".join([*words(53, 5), *swapped]).upper(), "en", "s"), (3, " ".join(words(54, 200)), "en", "s"), (4, ", ".join(item[:13]), "en", "s"), (5, " ".join(item[:12]), "en", "s"), (1, " ".join(item), "en", "s"), (None, " ".join(item), "en", "s")]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(words(55, 20))), (9, None)], "item_id long, text string")
    found = decontam.overlaps(docs(spark, rows), bench, broadcast_seeds=limit).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in found) == [(0, 7), (1, 7), (1, 7), (2, 7), (4, 7)]
    left = decontam.decontaminated(docs(spark, rows), bench, broadcast_seeds=limit)
    assert sorted(r.doc_id for r in left.collect()) == [3, 5]


def test_decontamination_of_short_items(spark):
    """Items below the window are found whole, with one word changed not at all; tiny ones never."""
    six = words(60, 6)
    rows = [(1, " ".join([*words(61, 20), *six, *words(62, 5)]), "en", "s"), (2, " ".join(six), "en", "s"), (3, " ".join([*six[:5], "other"]), "en", "s"), (4, "one two three", "en", "s"), (5, None, "en", "s")]
    bench = spark.createDataFrame([(7, " ".join(six).upper()), (8, "one two three"), (9, "")], "item_id long, text string")
    for limit in (10, 0):
        found = decontam.overlaps(docs(spark, rows), bench, broadcast_seeds=limit).collect()
        assert sorted((r.doc_id, r.item_id, r.matched, r.doc_at, r.item_at) for r in found) == [(1, 7, 6, 20, 0), (2, 7, 6, 0, 0)]
    assert sorted(r.doc_id for r in decontam.decontaminated(docs(spark, rows), bench).collect()) == [3, 4, 5]


def test_blocks_of_even_ids(spark):
    """Ids that are multiples of the number of blocks are spread all the same."""
    for step in (mixing.BLOCKS, training_order.BLOCKS):
        ids = spark.range(0, 5000 * step, step)
        most = ids.groupBy(mixing.block_of(F.col("id"), mixing.BLOCKS).alias("b")).count().agg(F.max("count")).first()[0]
        assert most < 5 * 5000 / mixing.BLOCKS


def test_one_id_on_very_many_rows(spark):
    """A sample is bounded by rows, not by ids."""
    many = docs(spark, [(1, f"good words number {i}", "en", "s") for i in range(5000)] + [(i, "bad ### words", "en", "s") for i in range(2, 60)])
    marks = labels(spark, [(i, int(i == 1), 0) for i in range(60)])
    assert quality.labelled_sample(many, marks, "quality", F.lit(True), 1000).count() == 59
    assert language.predictions(many).count() == 5058


def test_line_dedup_small_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    rows = [(i, f"{SHARED}\nown line of document {i} that nobody else has in it at all\n  {SHARED.upper()} \nshort", "en", "s") for i in range(60)]
    rows += [(100 + i, f"four documents hold this line, which is one too few to matter {i // 4}\nx", "en", "s") for i in range(40)]
    rows += [(500, f"{SHARED}\n{SHARED}", "en", "s"), (None, SHARED, "en", "s"), (5, "another text of document five", "en", "s")]
    got = line_dedup.digest(docs(spark, rows)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_lines): r for r in got}
    assert all(by[i, 4].n_dropped == 2 for i in range(60))
    assert by[500, 2].n_dropped == 0 and by[None, 1].n_dropped == 1
    assert all(by[100 + i, 2].n_dropped == 0 for i in range(40))
    assert by[None, 1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    kept = line_dedup.deduplicated(docs(spark, rows[:60] + rows[-3:])).collect()
    assert {r.text for r in kept if r.doc_id == 500} == {f"{SHARED}\n{SHARED}"}


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_line_dedup_any_batches(spark, batch):
    """Keys over many batches and partitions, null ids and documents that repeat a line, against plain counting."""
    rng = np.random.default_rng(21)
    lines = [f"line {k} is long enough to be looked at by the operator" for k in range(12)]
    rows = [(i if i % 9 else None, "\n".join(rng.choice(lines[: 1 + i % 12], 4)), "en", "s") for i in range(90)] + [(1000, "\n".join([lines[11]] * 40), "en", "s")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    got = line_dedup.digest(docs(spark, rows)).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    holders = {}
    for i, t, *_ in rows:
        for x in t.split("\n"):
            holders.setdefault(x, set()).add(i)
    keeper = {x: max(d, key=lambda i: -1 if i is None else i) for x, d in holders.items() if len(d) >= 5}
    want = []
    for i, t, *_ in rows:
        kept = [x for x in t.split("\n") if keeper.get(x, i) == i]
        want.append((i, t.count("\n") + 1, t.count("\n") + 1 - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def brute_components(texts, width, bits):
    def fp(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = [fp(t) for t in texts]
    root = list(range(len(f)))
    for i, j in combinations(range(len(f)), 2):
        if (f[i] ^ f[j]).bit_count() <= bits:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return f, root


@pytest.mark.parametrize("node_rows", [simhash.NODE_ROWS, 8])
def test_simhash_brute_force(spark, monkeypatch, node_rows):
    monkeypatch.setattr(simhash, "NODE_ROWS", node_rows)
    base, rng, texts = words(9, 120), np.random.default_rng(3), [None, "", "one", "two words", "THREE words here"]
    for _ in range(120):
        w = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 3)):
            w[at] = "x" + w[at]
        texts.append(" ".join(w))
    texts += [" ".join(words(100 + i, 50)) for i in range(60)]
    f, root = brute_components(texts, 3, 2)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i].fingerprint for i in range(len(f))] == [f"{x:016x}" for x in f]
    assert [got[i].component_id for i in range(len(f))] == root


def test_gray_search_finds_all_pairs():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([codes, *(codes ^ np.uint64(1 << b) for b in (0, 5, 63, 40))]))
    order = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        order ^= order >> np.uint64(s)
    codes = codes[np.argsort(order)]
    want = {(a, b) for a in range(len(codes)) for b in range(a + 1, len(codes)) if int(codes[a] ^ codes[b]).bit_count() <= 2}
    got = {(int(a), int(b)) for x, y in simhash.linked_pairs(codes, 2) for a, b in zip(x, y, strict=True)}
    assert got == want


def test_one_of_each_keeps_clean_documents(spark):
    base = words(70, 300)
    near = [w if i not in (50, 200) else "new" for i, w in enumerate(base)]
    rows = [(10, " ".join(base), "en", "s"), (11, " ".join(base).upper(), "en", "s"), (12, " ".join(near), "en", "s"), (13, " ".join(words(71, 300)), "en", "s"), (14, " ".join(base[:150]), "en", "s"), (13, " ".join(words(71, 300)), "en", "s"), (15, None, "en", "s"), (16, "", "en", "s")]
    out = simhash.one_of_each(docs(spark, rows))
    assert sorted(r.doc_id for r in out.collect()) == [10, 13, 14, 15]
    assert out.columns == docs(spark, rows).columns


def jaccard_groups(texts):
    """Least index of every text's component under five-word Jaccard similarity 0.8, by brute force."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(sets)))
    for i, j in combinations(range(len(sets)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def kept_and_wanted(spark, texts):
    kept = simhash.one_of_each(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]))
    return sorted(r.doc_id for r in kept.collect()), sorted(set(jaccard_groups(texts)))


def test_one_of_each_star_group(spark):
    rng, base, texts = np.random.default_rng(11), words(90, 400), []
    for i in range(60):
        w = list(base)
        for at in rng.choice(400, 6, replace=False):
            w[at] = f"new{i}x{at}"
        texts.append(" ".join(w))
    texts.insert(30, " ".join(base))
    texts += [" ".join(words(500 + i, 80)) for i in range(10)]
    kept, wanted = kept_and_wanted(spark, texts)
    assert len(wanted) == 11 and kept == wanted


def test_one_of_each_cut_and_extended_copies(spark):
    texts = []
    for i in range(24):
        w = words(700 + i, 200)
        texts += [" ".join(w), " ".join([*w[:166], *words(800 + i, [0, 4][i % 2])]), " ".join([*words(900 + i, 20), *w, *words(950 + i, 20)])]
    kept, wanted = kept_and_wanted(spark, texts)
    assert len(wanted) == 24 and kept == wanted


def test_one_of_each_equal_word_sets(spark):
    rng, base = np.random.default_rng(12), words(91, 60)
    texts = [" ".join(rng.permutation(base)) for _ in range(150)]  # one word set, nothing in common
    texts += [" ".join([*base, *base[:k]]) for k in range(30)] + [" ".join([*base, *base, *base[:k]]) for k in range(3)]
    kept, wanted = kept_and_wanted(spark, texts)
    assert len(wanted) > 150 and kept == wanted


def test_one_of_each_makes_rows_not_pairs(spark):
    base = words(92, 150)
    texts = [" ".join([*base[:75], f"id{i}", *base[76:]]) for i in range(300)]
    table = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    suspects = simhash._content(table, 5, 0.8).withColumnRenamed("doc_id", "v").cache()
    postings = simhash._postings(suspects).cache()
    pairs = simhash._by_pivot(postings, 0.8).distinct().cache()
    members = postings.count()
    assert 299 <= pairs.count() <= members < 300 * 40
    assert simhash._across(postings, pairs, 0.8).count() == 0


def test_one_of_each_below_the_threshold(spark):
    """Copies at both sides of the threshold, none equal to another, chains among them."""
    rng, base, texts = np.random.default_rng(13), words(93, 100), []
    for i in range(80):
        w = list(base)
        for at in rng.choice(100, int(rng.integers(1, 6)), replace=False):
            w[at] = f"n{rng.integers(0, 4)}x{at}"
        texts.append(" ".join(w[: int(rng.integers(80, 101))]))
    texts += ["one", "two words", "two words", "a b c d e", "a b c d e f"]
    kept, wanted = kept_and_wanted(spark, texts)
    assert 8 < len(wanted) < 80 and kept == wanted


def test_mixing_targets_and_copies(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), "en", ["a", "b", "c", None][min(3, int(rng.integers(0, 9)) // 2)]) for i in range(800)]
    got = mixing.mix(docs(spark, rows)).collect()
    total, by = sum(r.size for r in got), {}
    for r in got:
        assert r.taken <= 2 * r.size and r.taken == r.size * r.copies
        by.setdefault(r.source, [0, r.target, r.source_size])[0] += r.taken
    assert abs(sum(t for _, t, _ in by.values()) - 1.5 * total) < 1e-6 * total
    for taken, target, size in by.values():
        assert target <= 2 * size + 1e-9 and abs(taken - target) < 0.03 * target + 60
    again = mixing.mix(docs(spark, rows).repartition(5))
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again.collect()}
    mixed = mixing.mixed_documents(docs(spark, rows))
    assert mixed.count() == sum(r.copies for r in got) and mixed.columns == docs(spark, rows).columns
    twice = docs(spark, [(1, "a b", "en", "a"), (1, "a b", "en", "a"), (2, "c", "en", "b")])
    assert mixing.mixed_documents(twice).count() == sum(r.copies for r in mixing.mix(twice).collect())


def test_quality_and_toxicity_learn(spark):
    good, bad, slur = words(80, 60), ["###", "%%%", "$$$"], ["vileword", "vileness", "idiot"]
    rng = np.random.default_rng(6)
    rows, marks = [], []
    for i in range(600):
        w = list(rng.choice(good, 40))
        if i % 4 == 0:
            w = [x + str(rng.choice(bad)) for x in w]
        if i % 5 == 0:
            w[7], w[20] = rng.choice(slur), rng.choice(slur)
        rows.append((i, " ".join(w), "en", "s"))
        marks.append((i, int(i % 4 != 0), int(i % 5 == 0)))
    table, l = docs(spark, rows), labels(spark, marks)
    q = [r for r in quality.predictions(table, l).collect() if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in q]) > 0.95
    t = [r for r in toxicity.predictions(table, l).collect() if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in t]) > 0.95
    assert quality.accepted(table, l).columns == table.columns


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(7)
    y = rng.random(6000) < 0.2
    votes = np.stack([np.where(rng.random(6000) < 0.9, y, ~y).astype(int) for _ in range(4)] + [np.full(6000, -1)] * 2, axis=1)
    votes[:, 4] = np.where(votes[:, 0] == 1, 1, -1)  # repeats the first voter
    votes[:, 5] = np.where(rng.random(6000) < 0.5, -1, y)
    model = toxicity.LabelModel().fit(votes.astype(np.int8))
    assert abs(model.prior[1] - 0.2) < 0.05
    assert np.mean((model.posterior(votes.astype(np.int8)) > 0.5) == y) > 0.95
    assert {int(model.parent[4]), int(model.parent[0])} & {0, 4}


def lm_brute_force(rows, good):
    """(n_words, target loss, background loss) of every row by counting the other rows."""
    tokens = [[*(t or "").split(), None] for _, t in rows]
    pairs = [list(zip(["<s>", *w], w, strict=False)) for w in tokens]
    kinds, out = len({w for ws in tokens for w in ws}), []
    target = [i in good for i, _ in rows]
    n = [sum(len(w) for w, g in zip(tokens, target, strict=True) if g), sum(map(len, tokens))]
    for row, ps in enumerate(pairs):
        losses = []
        for members, scale in ((target, 1.0), ([True] * len(rows), n[0] / n[1])) if n[0] else (([True] * len(rows), 1.0),) * 2:
            other = [k for k, m in enumerate(members) if m and k != row]
            seen = [q for k in other for q in pairs[k]]
            # the total is that of the model less the row's own tokens
            left = sum(len(tokens[k]) for k in other)
            loss = 0.0
            for c, w in ps:
                single = (scale * sum(q[1] == w for q in seen) + lm_score.NU / kinds) / (scale * left + lm_score.NU)
                loss -= np.log2((scale * sum(q == (c, w) for q in seen) + lm_score.MU * single) / (scale * sum(q[0] == c for q in seen) + lm_score.MU))
            losses.append(loss / len(ps))
        words = len(ps) - 1
        out.append((words, *(losses if words else (0.0, 0.0))))
    return out


@pytest.mark.parametrize("limit", [lm_score.BROADCAST_ROWS, 0])
def test_lm_score_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(lm_score, "BROADCAST_ROWS", limit)
    rows = [(0, "the cat sat on the cat"), (1, "the dog ran"), (2, "zzz qqq the"), (3, ""), (4, None), (5, "tac eht"), (6, "the cat sat on the cat"), (0, "the cat sat on the cat"), (7, " ".join(words(7, 300)))]
    for good in ({0, 1}, set()):
        wanted = {(i, *(round(x, 9) for x in w)) for (i, _), w in zip(rows, lm_brute_force(rows, good), strict=True)}
        got = lm_score.scores(docs(spark, [(i, t, "en", "s") for i, t in rows]), labels(spark, [(i, int(i in good), 0) for i in range(3)])).collect()
        assert len(got) == len(rows)
        assert {(r.doc_id, r.n_words, round(r.target_loss, 9), round(r.background_loss, 9)) for r in got} == wanted
        assert all(abs(r.score - (r.target_loss - r.background_loss)) < 1e-12 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[6].background_loss < by[7].background_loss  # a text that occurs elsewhere too


def test_word_hashes_in_pieces(monkeypatch):
    rows = ["", None, "  ", "aB é\n\tx", "x" * 700, "one two", " ".join(words(8, 90)), "ÀB b\x0bc"]
    wanted = None
    for piece in (1 << 16, 1, 2, 3, 64):
        monkeypatch.setattr(word_hashing, "PIECE", piece)
        hashes, bounds = word_hashing.word_hashes(Texts(pa.array(rows)), True)
        assert np.diff(bounds).tolist() == [len((t or "").encode().split()) for t in rows]
        wanted = hashes if wanted is None else wanted
        assert (hashes == wanted).all()
    flat = [w.lower() for t in rows for w in (t or "").encode().split()]
    assert len(set(wanted.tolist())) == len(set(flat)) and {w: h for w, h in zip(flat, wanted.tolist(), strict=True)} == dict(zip(flat, wanted.tolist(), strict=True))


def test_tally_counts_over_all_slices(spark, monkeypatch):
    monkeypatch.setattr(tally, "SLICE_BYTES", (200, 200))
    monkeypatch.setattr(tally, "PART_BYTES", (100, 100))
    table = docs(spark, [(i, f"{i % 7} {i % 3} all", "en", "s") for i in range(210)])

    def keys_of(rows):
        h, _ = word_hashing.word_hashes(Texts(rows.column("text").combine_chunks()), False)
        keys, n = np.unique(h, return_counts=True)
        return keys, n[None]

    def finish(rows, keys, totals, whole):
        h, bounds = word_hashing.word_hashes(Texts(rows.column("text").combine_chunks()), False)
        found = totals[0, np.searchsorted(keys, h)].astype(np.int64).reshape(-1, 3)
        return pa.table({"doc_id": rows.column("doc_id"), "a": found[:, 0], "b": found[:, 1], "c": found[:, 2]})

    got = tally.tallied(table.select("doc_id", "text"), 1500, 64, keys_of, finish, "doc_id long, a long, b long, c long").collect()
    count = Counter(w for i in range(210) for w in f"{i % 7} {i % 3} all".split())
    assert len(got) == 210
    assert all((r.a, r.b, r.c) == (count[str(r.doc_id % 7)], count[str(r.doc_id % 3)], 210) for r in got)
