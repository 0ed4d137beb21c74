import brute
import corpus_pipeline as P
import pytest
from furrow.llm.queries import QUERIES
from furrow.session import stored
from small_tables import SF

# Among them are names that the stages or their operators use inside.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _key string, key0 string, _lang_pred int, LANG_PRED string, "
COLUMNS += "score double, _score string, id string, h long, n_tokens string, topic string, probability double, kept string, size int"


def row(i, text, lang, source):
    return (i, text, lang, source, 5, "k", "k0", 7, "lp", 0.5, "s", "own", 9, "n", "t", 0.25, "kp", 3)


def as_rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_stages(odd_rows, spark):
    """Each stage on its own input, held against plain Python; all columns come through, rows unchanged."""
    texts = {"en": "the house and the garden are with the river ", "de": "das Haus und der Garten sind mit dem Fluß ", "fr": "la maison et le jardin près de la rivière "}
    rows = [(1000 + i, (texts[lang] * (3 + i % 5)) + str(i) * (i % 2), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    # rows without an id: a near copy of another one, and copies
    lonely = " ".join(f"the house {k} and the garden {k} are with the river" for k in range(40))
    rows += [(None, lonely, "en"), (None, lonely + " again", "en"), (None, lonely, "en")]
    docs = spark.createDataFrame([row(i, t, lang, "src1") for i, t, lang in rows] + [row(i, t, None, "src0") for i, t in odd_rows], COLUMNS)
    kept = stored(P.language(spark, docs, ""))
    assert kept.columns == docs.columns and set(as_rows(kept)) <= set(as_rows(docs))
    before = [(r.doc_id, r.text) for r in kept.collect()]
    assert {(i, t) for i, t, _ in rows} <= set(before) and not {t for _, t in before} & {None, "", " \t\n "}

    single = stored(P.dedup(spark, kept, ""))
    assert single.columns == docs.columns
    best = {}
    for i, t in before:
        best[t] = max(best.get(t, i), i, key=lambda x: (x is not None, x or 0))
    found = [(r.doc_id, r.text) for r in single.collect()]
    assert sorted(map(str, found)) == sorted(str((i, t)) for t, i in best.items())

    near = stored(P.near_dedup(spark, single, ""))
    left = {t for t, in near.select("text").collect()}
    # every text on its own, by place, as ids repeat
    root = brute.classes([(k, t) for k, (_, t) in enumerate(found)], 5, 80, 100)
    groups = {}
    for k, (_, t) in enumerate(found):
        groups.setdefault(root[k], []).append(t)
    assert len(groups) < len(found) and near.count() == len(groups)
    assert all(sum(t in left for t in group) == 1 for group in groups.values())

    mixed = stored(P.mixed(spark, near, ""))
    assert mixed.columns == docs.columns and set(as_rows(mixed)) <= set(as_rows(near)) and 0 < mixed.count() < near.count()
    packed = P.packed(spark, mixed, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed.collect()}


def test_copies_under_ids_with_several_texts(spark):
    """A row goes with its text, not with its id."""
    docs = spark.createDataFrame([(1, "a b c"), (1, "other text here"), (2, "a b c"), (2, "a b c"), (None, None), (None, "x"), (None, "x")], "doc_id long, text string")
    assert as_rows(P.dedup(spark, docs, "")) == as_rows(spark.createDataFrame([(1, "other text here"), (2, "a b c"), (None, None), (None, "x")], docs.schema))


def test_numbers_differ(spark, monkeypatch):
    """Where two rows come to one number, another salt is taken."""
    docs = spark.createDataFrame([(k % 7, f"t{k}") for k in range(50)] + [(0, "t0"), (None, "t0")], "doc_id long, text string")
    whole = P.F.xxhash64
    monkeypatch.setattr(P.F, "xxhash64", lambda *c: P.F.pmod(whole(*c), P.F.lit(1_000)))
    number = P.row_number_of(docs)
    monkeypatch.undo()
    assert docs.select(number.alias("n")).distinct().count() == docs.distinct().count() == 51


def test_run(spark):
    out = P.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)


def test_empty(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert P.packed(spark, docs, "").count() == 0


@pytest.mark.parametrize("name", ["op2_sentence_dedup", "op3_token_files", "op5_language_id", "op6_best_fit", "op7_suffix_dedup", "op10_mixing"])
def test_registered_queries_answer_for_every_document(spark, name):
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    got = QUERIES[name](spark, SF)
    assert {r.doc_id for r in got.select("doc_id").collect()} == ids
