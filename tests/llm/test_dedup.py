import collections
import hashlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from furrow.llm import common as C
from furrow.llm import exact_dedup as E
from furrow.llm import ngram_join as N
from furrow.llm import suffix_dedup as S
from furrow.llm.components import connected_components
from furrow.llm.exact_dedup import exact_dedup
from furrow.llm.sentence_dedup import dedup_sentences
from furrow.llm.suffix_dedup import dedup_substrings
from furrow.session import stored
from pyspark.sql import functions as F


def test_exact(table_of, odd_rows):
    got = sorted((r.text_sha256, str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup(table_of(odd_rows)).collect())
    groups = collections.defaultdict(list)
    for i, t in odd_rows:
        groups[t or ""].append(i)
    keep = {t: max(ids, key=lambda i: (i is not None, i or 0)) for t, ids in groups.items()}
    want = sorted(
        (hashlib.sha256((t or "").encode()).hexdigest(), str(i), str(keep[t or ""]), len(groups[t or ""]), i == keep[t or ""]) for i, t in odd_rows
    )
    assert got == want


@pytest.mark.parametrize("names", [1, 3])
def test_exact_tells_colliding_names_apart(spark, table_of, odd_rows, names):
    """Where different chunks share a name, as a collision would have it, their digests tell texts apart."""
    texts = C.keyed(table_of(odd_rows), "doc_id", "text", 1).select("id", "th", "text")
    read = texts.mapInArrow(E.recipes, E.RECIPES)
    clashing = F.transform("chunks", lambda c: c.withField("name", F.pmod(c["name"], F.lit(names))))
    got, want = (E.grouped(stored(r)) for r in (read.withColumn("chunks", clashing), read))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    chunks = spark.createDataFrame([(1, b"a"), (1, b"b"), (1, b"a"), (2, b"c"), (2, b"c")], "name long, digest binary")
    assert sorted((r.name, bytes(r.digest), r.variant or 0) for r in E.with_variants(chunks).collect()) == [(1, b"a", 1), (1, b"a", 1), (1, b"b", 2), (2, b"c", 0), (2, b"c", 0)]


def test_exact_moves_no_chunks_by_name(spark, table_of, odd_rows):
    """Chunks are dealt by document; names only meet as one partial row for each task."""
    read = stored(table_of(odd_rows).select(F.col("doc_id").alias("id"), F.lit(0).alias("th"), "text").mapInArrow(E.recipes, E.RECIPES))
    chunks = read.select("id", F.explode("chunks").alias("c")).select("id", "c.*")
    plan = E.with_variants(chunks)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_substrings(table_of, odd_rows):
    got = collections.Counter()
    for r in dedup_substrings(table_of(odd_rows)).collect():
        removed = sum(x["stop"] - x["start"] for x in r.removed)
        got[r.doc_id, (r.n_bytes, removed, len(r.removed), hashlib.sha256(r.kept).hexdigest())] += 1
    found = brute.substrings(odd_rows)
    # one id with two texts: their order is that of a hash, so only the other documents are compared
    assert {k: v for k, v in got.items() if k[0] != 8} == collections.Counter((i, found[i, t or ""]) for i, t in odd_rows if i != 8)


@pytest.mark.parametrize("depth", [64, 100, 140])
def test_substrings_depth(table_of, depth):
    rows = [(i, ("ab" * 40 + chr(97 + i % 5) * (i % 90) + "xyz" * 30)[i % 7 :]) for i in range(25)]
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in dedup_substrings(table_of(rows), depth=depth).collect()}
    assert got == {i: v for (i, _), v in brute.substrings(rows, depth).items()}


@pytest.mark.parametrize("many", [0, 3, 64])
def test_substrings_by_whole_windows(table_of, odd_rows, many, monkeypatch):
    """Blocks of common grams are dealt out by windows; the result is the same wherever the border lies."""
    monkeypatch.setattr(S, "MANY", many)
    passage = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(130))
    rows = [(i, t) for i, t in odd_rows if i != 8] + [(100 + k, f"{k:07d}" * (k % 9) + passage[k % 4 :] + f"{k * 37:09d}" * (k % 5)) for k in range(90)]
    got = collections.Counter((r.doc_id, (r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), hashlib.sha256(r.kept).hexdigest())) for r in dedup_substrings(table_of(rows)).collect())
    found = brute.substrings(rows)
    assert got == collections.Counter((i, found[i, t or ""]) for i, t in rows)


def test_a_common_passage_is_in_no_large_group():
    """Documents around one passage: what meets under one key does not grow with them."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    passage = bytes(rng.integers(97, 123, 120, dtype=np.uint8)).decode()
    most = {}
    for docs in (200, 400, 800):
        texts = [bytes(rng.integers(97, 123, 200, dtype=np.uint8)).decode() for _ in range(docs)]
        table = pa.table({"id": pa.array(range(docs), pa.int64()), "th": pa.array([0] * docs, pa.int32()),
                          "text": [t[:100] + passage + t[100:] for t in texts]})
        # one bucket for all of them, so that a group is what shares a key
        found = pa.Table.from_batches(list(S.find_blocks(100, 1)(iter(table.to_batches()))))
        settled = S.settle_blocks(100, 1)(found)
        cut = S.cut_blocks(100, 1)(table, settled)
        keys = C.unpack(S.held(cut, "blocks"), ["<u8", *S.REQUEST_TYPES, ("u1", 168)])[0]
        windows = C.unpack(S.held(cut, "windows"), S.WINDOW_TYPES)
        most[docs] = max([*collections.Counter(keys.tolist()).values(), *collections.Counter(windows[0].tolist()).values()])
        gone = C.unpack(C.payloads(S.sort_suffixes(100, 1)(cut), S.SPAN), S.SPAN_TYPES)
        # a byte beside the passage may agree by chance
        assert sorted(gone[0].tolist()) == list(range(1, docs)) and min(gone[2]) >= 96 and max(gone[2]) == 100 and min(gone[3]) == 220 and max(gone[3]) <= 224
        assert cut.num_rows == 1  # one row for each bucket
    assert max(most.values()) <= S.MANY


def test_sentences(table_of, odd_rows):
    got = collections.Counter((r.doc_id, (r.n_sentences, r.n_removed, r.kept)) for r in dedup_sentences(table_of(odd_rows)).collect())
    found = brute.kept_sentences(odd_rows)
    assert {k: v for k, v in got.items() if k[0] != 8} == collections.Counter((i, found[i, t or ""]) for i, t in odd_rows if i != 8)


def test_passage_goes_and_clean_text_stays(table_of):
    passage = "One sentence of this passage has some ten words in all. The second of its sentences is no shorter than that one. And a third."
    rows = [(1, "Clean opening here. " + passage), (2, passage + "\nOther words follow it."), (3, "Nothing here stands elsewhere. It all stays as it is, every word.")]
    got = {r.doc_id: r.kept for r in dedup_sentences(table_of(rows)).collect()}
    assert got == {1: rows[0][1], 2: "Other words follow it.", 3: rows[2][1]}


@pytest.mark.parametrize(("words", "num", "tile"), [(4, 85, 1500), (5, 80, 1500), (3, 50, 2), (1, 30, 3)])
def test_ngram_join(table_of, odd_rows, words, num, tile, monkeypatch):
    monkeypatch.setattr(N, "TILE", tile)
    rows = odd_rows + [(100 + k, " ".join(f"t{j}" for j in range(k % 4, 40 + k % 3))) for k in range(12)]
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in N.ngram_join(table_of(rows), words=words, num=num).collect())
    root = brute.classes(rows, words, num, 100)
    assert got == collections.Counter((i, len(brute.shingles(t, words)), root[i]) for i, t in rows)


def test_equal_sets_are_tiled_once(table_of, monkeypatch):
    """Copies, also with other spaces and capitals, move as one document; their classes stay the same."""
    monkeypatch.setattr(N, "TILE", 3)
    moved, tiles = [], N._tiles

    def counted(*args):
        found = tiles(*args)
        moved.append(found.count())
        return found

    monkeypatch.setattr(N, "_tiles", counted)
    base = " ".join(f"t{j}" for j in range(60))
    rows = [(k, [base, base.upper(), base.replace(" ", "  ")][k % 3]) for k in range(60)] + [(60, base + " t99"), (61, "all alone here it is"), (62, "all alone here it is")]
    got = {r.doc_id: r.component_id for r in N.ngram_join(table_of(rows)).collect()}
    root = brute.classes(rows, 5, 80, 100)
    assert got == {i: root[i] for i, _ in rows}
    assert moved == [2, 2]


def test_long_texts_that_share_a_passage_part_by_bitmaps(table_of, monkeypatch):
    """Bitmaps have as many bits as a set has shingles, so only what may really link is compared by its texts."""
    moved, tiles = [], N._tiles

    def counted(*args):
        found = tiles(*args)
        moved.append(found.count())
        return found

    monkeypatch.setattr(N, "_tiles", counted)
    shared = " ".join(f"t{j}" for j in range(1500))
    rows = [(k, shared + "".join(f" d{k}w{j}" for j in range(1300 + 100 * k))) for k in range(6)]
    rows += [(10, rows[5][1] + " one more word"), (11, rows[0][1] + " another word")]
    got = {r.doc_id: r.component_id for r in N.ngram_join(table_of(rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 10: 5, 11: 0}
    assert moved == [8, 4]


def test_bitmaps_come_to_few_tiles(spark, monkeypatch):
    """A document of a large class comes to a bounded number of tiles of bitmaps, whatever the size of the class."""
    monkeypatch.setattr(N, "TILE", 2)
    classes = spark.range(1, 601).selectExpr("id", "1L as component")
    sizes = spark.range(1, 601).selectExpr("id", "50 + id % 20 as size")
    moved = N._tiles(classes, sizes, N.Bands(80, 100), N.BIT_TILE, N.BIT_SHINGLES).groupBy("id").count()
    assert moved.count() == 600 and max(r["count"] for r in moved.collect()) <= 12


def test_bitmaps_of_several_lengths_are_folded():
    """A bitmap folded to fewer bits is that of the same set with fewer bits."""
    import pyarrow as pa

    random = np.random.default_rng(3)
    size = np.sort(random.integers(1, 5000, 60))
    offsets = np.concatenate(([0], np.cumsum(size)))
    values = np.concatenate([np.sort(random.integers(0, 2**63, n).astype(np.uint64)) for n in size.tolist()])
    level = N.levels(size)
    bits = [N.bitmaps(values, offsets, np.array([k]), int(N.LEVELS[level[k]])).tobytes() for k in range(len(size))]
    differ = N.folded(N.Bands(30, 100), size, pa.array(bits, pa.binary()))
    for i in range(len(size) - 1):
        others = np.arange(i + 1, np.searchsorted(size, N.Bands(30, 100).largest(size[i]), side="right"))
        bitmap = N.bitmaps(values, offsets, np.arange(len(size)), int(N.LEVELS[level[i]]))
        assert differ(i, others).tolist() == N.differing(bitmap, i, others).tolist()
    assert len(set(level.tolist())) > 2


def test_copies_and_ids_with_several_texts(table_of):
    """Copies hang on two levels of representatives; an id with several texts links the sets of all of them."""
    sets = [" ".join(f"s{k}w{j}" for j in range(30)) for k in range(6)]
    rows = [(200 - i, sets[i % 3]) for i in range(90)]  # copies in falling order of id
    rows += [(500, sets[3]), (501, sets[3]), (502, sets[4]), (501, sets[4]), (300, sets[5]), (110, sets[5]), (301, sets[5])]
    rows += [(None, sets[0]), (None, "a text of its own that has words")]
    got = collections.Counter((r.doc_id, r.component_id) for r in N.ngram_join(table_of(rows)).collect())
    root = brute.classes(rows, 5, 80, 100)
    assert got == collections.Counter((i, root[i]) for i, _ in rows)


def test_sets_are_laid_side_by_side_in_parts(monkeypatch):
    """One set meets all others of its tile a bounded number of shingles at a time; the classes stay the same."""
    import pyarrow as pa

    base = [f"t{j}" for j in range(300)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k:]]) for k in range(30)] + [" ".join(f"u{k}w{j}" for j in range(300)) for k in range(10)]
    group = pa.table({"pair": ["p"] * 40, "side": pa.array([0] * 40, pa.int32()), "id": list(range(40)), "text": texts})
    once = N.compare_texts(5, N.Bands(80, 100))(group)
    most, expand = [], N.expand

    def counted(*args):
        found = expand(*args)
        most.append(len(found[0]))
        return found

    monkeypatch.setattr(N, "expand", counted)
    monkeypatch.setattr(N.in_parts, "__defaults__", (2000,))
    assert N.compare_texts(5, N.Bands(80, 100))(group).equals(once) and once.num_rows == 29
    assert max(most) <= 2000


def test_pairs_with_long_texts_are_not_put_together():
    """Small pairs are compared in one call up to some megabytes of text, whatever the number of their rows."""
    import pyarrow as pa

    calls = []

    def compare(group):
        calls.append((group.num_rows, sorted(set(group.column("pair").to_pylist()))))
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    rows = [(f"{k:03}", "x" * (1 << 20)) for k in range(40) for _ in range(2)]
    batches = [pa.RecordBatch.from_pylist([{"pair": p, "text": t} for p, t in rows[i : i + 7]]) for i in range(0, 80, 7)]
    assert not any(b.num_rows for b in N.in_turn(compare)(iter(batches)))
    assert sum(n for n, _ in calls) == 80 and max(n for n, _ in calls) <= 10
    assert [p for _, pairs in calls for p in pairs] == [f"{k:03}" for k in range(40)]


def test_long_texts_make_small_batches(spark):
    import pyarrow as pa

    C.small_batches(spark)

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    long = spark.range(0, 60, 1, 1).selectExpr("id", "repeat('abcdefghij', 60000) as text")
    found = [r.n for r in long.mapInArrow(rows, "n long").collect()]
    assert sum(found) > 60 * 600_000 and max(found) < C.BATCH_BYTES + (1 << 20)


@pytest.mark.parametrize(("setting", "number"), [("10000", 10000), ("67108864b", 64 << 20), ("64MB", 64 << 20), ("8m", 8 << 20), ("-1", -1)])
def test_settings_with_units(setting, number):
    assert C.bytes_in(setting) == number


def test_pairs_of_tiles_are_held_one_after_another(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(N, "FEW", 4)
    sizes = [3, 1, 9, 9, 2, 1, 1, 1, 20]
    pairs = [f"p{k}" for k, size in enumerate(sizes) for _ in range(size)]
    batches = [pa.RecordBatch.from_pydict({"pair": pairs[i : i + 5]}) for i in range(0, len(pairs), 5)]
    groups = []

    def compare(group):
        groups.append(group.column("pair").to_pylist())
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    assert not [b for b in N.in_turn(compare)(iter(batches)) if len(b)]
    assert sum(groups, []) == pairs
    assert [sorted(set(g)) for g in groups] == [["p0", "p1"], ["p2"], ["p3"], ["p4", "p5", "p6"], ["p7", "p8"]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), max_size=30), min_size=2, max_size=8), st.sampled_from([(85, 100), (80, 100), (50, 100), (1, 1)]))
def test_linked_sets_share_a_part(sets, threshold):
    """The candidate step loses no link, whatever parts are empty."""
    bands = N.Bands(*threshold)
    from furrow.llm.bytehash import mixed

    arrays = [np.sort(mixed(np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15))) for s in sets]
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays])))
    key, doc = N.part_keys(bands, np.concatenate(arrays), offsets)
    keys = [set(key[doc == d].tolist()) for d in range(len(sets))]
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and threshold[1] * len(sets[a] & sets[b]) >= threshold[0] * len(sets[a] | sets[b]):
                assert keys[a] & keys[b]


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(130, 100), (5, 5), (None, 3), (200, 201), (201, 200)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 131)} | {200: 200, 201: 200}


def test_empty_tables(table_of):
    empty = table_of([])
    for run in (exact_dedup, dedup_substrings, dedup_sentences, N.ngram_join):
        assert run(empty).count() == 0
