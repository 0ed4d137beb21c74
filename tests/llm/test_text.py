import collections
import zlib

import numpy as np
import pytest

from furrow.llm import language_id as L
from furrow.llm import url_filter as U
from furrow.llm.mixing import OTHER, PART, TARGETS, capped_rake, lifted, margins, mix, rake, reachable, topic
from furrow.llm.queries import ORACLES, QUERIES
from furrow.llm.url_filter import RULES, Rule, filter_urls
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

URLS = [
    None, "", "no scheme", "http://", "HTTP://Net/", "http://net", "http://a.NET/x?y#z", "http://example.net/en/1", "http://x.example.net/en",
    "http://badexample.com/de/", "http://example.com/de/", "http://example.com/DE/", "ftp://b.org/fr/://x", "http://fr.org?q=/fr/", "http://net:80/",
    "http://org/fr/#", "http://internet/", "a://b.net/a://example.com/de/", "http://münchen.net/ü\nx",
]


def judge(url, rules, default="allow"):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fits, key=lambda r: (-len(r.name), r.name), default=None)
    return host, path, best and best.name, best.verdict if best else default


@pytest.mark.parametrize("rules", [RULES, (), (*RULES, Rule("block", "example.net", "/en/1"), Rule("block", "de", ""), Rule("allow", "org", ""))])
def test_urls(spark, rules):
    df = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(URLS * 2)], "page_id long, url string, html string, host string, best string")
    got = {r.page_id: tuple(r)[1:] for r in filter_urls(df, rules).collect()}
    assert got == {i: judge(u, rules) for i, u in enumerate(URLS * 2)}


MANY = [
    *RULES, Rule("block", "example.net", "/en/1"), Rule("block", "", "/a://b"), Rule("allow", "", "/"), Rule("block", "de", ""),
    *(Rule("block" if k % 3 else "allow", f"h{k}.example{k % 50}.com", f"/p{k % 7}" if k % 2 else "") for k in range(300)),
]


@pytest.mark.parametrize(("in_plan", "bytes_sent"), [(1000, 8 << 20), (0, 8 << 20), (0, 0)])
def test_urls_are_judged_alike_in_the_plan_and_by_join(spark, monkeypatch, in_plan, bytes_sent):
    """Rules without tokens, equal rows, rows without an id, very long URLs, one URL in a third of all rows."""
    monkeypatch.setattr(U, "IN_PLAN", in_plan)
    monkeypatch.setattr(U, "BROADCAST_BYTES", bytes_sent)
    long = "http://h7.example7.com/p0" + "/seg-ment" * 30_000
    urls = [*URLS, long, long + "?q", *(f"http://x.h{k}.example{k % 50}.com/p{k % 5}/y" for k in range(0, 320, 7))]
    urls += ["http://h3.example3.com/p3"] * len(urls)
    rows = [(i if i % 5 else None, u, "x", 1) for i, u in enumerate(urls)] + [(1, urls[1], "x", 1)] * 3
    df = spark.createDataFrame(rows, "page_id long, url string, token string, row int").repartition(3)
    got = collections.Counter(tuple(r) for r in filter_urls(df, MANY).collect())
    assert got == collections.Counter((i, *judge(u, MANY)) for i, u, *_ in rows)
    assert filter_urls(df.limit(0), MANY).count() == 0


def test_urls_meet_twenty_thousand_rules(spark, monkeypatch):
    rules = [Rule("block", f"site{k}.org", f"/dir{k % 11}/") for k in range(20_000)]
    df = spark.createDataFrame([(k, f"http://www.site{k}.org/dir{k % 13}/x") for k in range(0, 25_000, 50)], "page_id long, url string")
    found = filter_urls(df, rules)
    assert {r.page_id: r.rule for r in found.collect()} == {
        k: f"site{k}.org/dir{k % 11}/" if k < 20_000 and k % 11 == k % 13 else None for k in range(0, 25_000, 50)
    }
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Cartesian", "NestedLoop"))


def test_urls_run_no_python_and_move_no_rows(spark):
    plan = QUERIES["op4_url_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    import check_oracle

    message, _, rows = check_oracle.compare(spark, check_oracle.connect(SF), name, SF)
    assert not message
    assert rows > 0


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learn = docs.where(~L.held_out(F.col("doc_id")))
    network = L.fit(learn)
    got = L.identify(docs, network, lang="found", score="sure").collect()
    asked = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert set(got[0].asDict()) == {*docs.columns, "found", "sure"}
    assert len(asked) > 30 and sum(r.found == r.lang for r in asked) / len(asked) >= 0.9
    assert all(0 <= r.sure <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "12 $%& ...", "c"), (4, None, "d"), (None, "Le château est là", "e")], "doc_id long, text string, score string")
    found = {r.score: (r.lang_pred, r.sure) for r in L.identify(odd, network, score="sure").collect()}
    assert all(found[c] == ("und", 0.0) for c in "abcd") and found["e"][0] in network.languages
    assert L.identify(odd.limit(0), network).count() == 0


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert L.identify(df, L.fit(df)).first()["lang_pred"] == "und"


def plain_scores(network, text):
    """Language and score by loops: embedded bytes times filters at each place, maximum, softmax, mean by letters."""
    data, total, letters = text.encode(), np.zeros(len(network.languages)), 0
    for begin in range(0, len(data), L.WINDOW):
        window = data[begin : begin + L.WINDOW].ljust(L.WINDOW, b"\0")
        pooled = []
        for table in network.tables:
            places = range(L.WINDOW - len(table) + 1)
            pooled += [max(sum(float(table[k][window[p + k], f]) for k in range(len(table))) for p in places) for f in range(L.FILTERS)]
        z = np.maximum(np.array(pooled) + network.bias, 0) @ network.weights + network.last_bias
        p = np.exp(z - z.max())
        own = sum(bytes([b]).isalpha() or b >= 128 for b in window)
        total += own * p / p.sum()
        letters += own
    return network.languages[total.argmax()], total.max() / letters


def test_language_against_plain_convolution(spark):
    """A whole text, a very long one, repeated rows and rows that share an id, window by window in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    network = L.fit(docs.where(~L.held_out(F.col("doc_id"))))
    some = [t for (t,) in docs.where("doc_id % 60 = 2").select("text").collect() if t]
    texts = [some[0], some[1][:90] + " 123", "".join(t + "\n" for t in some[:4])[:6000], "x", "ünïcode"]
    long = (some[0] + " ") * 2000
    rows = [(k % 2, t, 7) for k, t in enumerate([*texts, *texts, long])]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text int")
    got = L.identify(df, network).collect()
    assert len(got) == len(rows) and {r._text for r in got} == {7}
    for text in texts:
        lang, score = plain_scores(network, text)
        own = [r for r in got if r.text == text]
        assert len(own) == 2 and all(r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4) for r in own)
    assert [r.lang_pred for r in got if r.text == long] == [plain_scores(network, some[0])[0]]
    narrow = L.identify(df, network, keep=["doc_id"])
    assert narrow.columns == ["doc_id", "lang_pred", "score"]
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in narrow.collect()) == sorted((r.doc_id, r.lang_pred, r.score) for r in got)


def test_sample_of_the_network_is_bounded(spark, monkeypatch):
    """Rows that share an id or have none, and many labels, send no more to the driver than the bounds say."""
    seen = {}
    monkeypatch.setattr(L, "train", lambda windows, labels, languages: seen.update(n=len(windows), languages=languages))
    monkeypatch.setattr(L, "MOST_ROWS", 120)
    monkeypatch.setattr(L, "MOST_LANGUAGES", 6)
    rows = [(None if k % 2 else 5, f"text {k if k % 4 else 0} of the sample", f"l{k % 3}") for k in range(3000)] + [(k, "odd label", f"odd{k:03d}") for k in range(200)]
    L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert seen["languages"] == ["l0", "l1", "l2", "odd000", "odd001", "odd002"] and 0 < seen["n"] <= 240
    rows = [(k, f"text {k}", f"l{k % 3}") for k in range(3000)]
    L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert 80 <= seen["n"] <= 160 and len(seen["languages"]) == 3


def test_windows_hold_every_byte():
    data = np.arange(1, 200, dtype=np.uint8).repeat(5)[:700]
    offsets = np.array([0, 0, 300, 556, 700])
    windows, doc = L.windows_of(data, offsets)
    for d in range(4):
        whole = windows[doc == d].ravel()
        size = offsets[d + 1] - offsets[d]
        assert (whole[:size] == data[offsets[d] : offsets[d + 1]]).all() and not whole[size:].any()


def test_gradient_of_the_network():
    """Training lowers the loss on what it sees."""
    rng = np.random.default_rng(0)
    windows = np.where(rng.random((200, L.WINDOW)) < 0.1, 65, 97).astype(np.uint8)
    windows[100:] += 1
    labels = np.repeat([0, 1], 100)
    network = L.train(windows, labels, ["a", "b"])
    assert (network.probabilities(windows).argmax(axis=1) == labels).mean() > 0.98


def test_rake():
    cells = np.random.default_rng(0).random((3, 4, 2)) * 100
    cells[0, :, 1] = 0
    shares = [np.array([0.2, 0.3, 0.5]), np.full(4, 0.25), np.array([0.6, 0.4])]
    fitted = cells * rake(cells, shares)
    for axis, share in enumerate(shares):
        assert np.allclose(fitted.sum(axis=tuple(a for a in range(3) if a != axis)) / fitted.sum(), share, atol=1e-6)


def plain_rake(cells, wanted):
    """Probabilities by bisection for one category after another, on a dictionary of cells."""
    factor = dict.fromkeys(cells, 1.0)
    for _ in range(400):
        for axis, goal in enumerate(wanted):
            for k, tokens in enumerate(goal):
                own = [c for c in cells if c[axis] == k and cells[c] > 0]
                low, high = 0.0, max([1 / max(factor[c], 1e-300) for c in own], default=0.0)
                for _ in range(120):
                    by = (low + high) / 2
                    low, high = (by, high) if sum(cells[c] * min(1, factor[c] * by) for c in own) < tokens else (low, by)
                for c in own:
                    factor[c] *= high
    return {c: min(1, f) if cells[c] else 0.0 for c, f in factor.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_capped_rake_against_plain_loops(seed):
    """Margins hold within the bound of one, and the probabilities are those of plain loops."""
    rng = np.random.default_rng(seed)
    cells = rng.random((3, 3, 2)) * 1000 + 100
    cells[0, :, 1] = 0
    cells[2, 2, 0] = 3.0  # a tiny cell
    shares = [np.array([0.5, 0.3, 0.2]), np.array([0.2, 0.3, 0.5]), np.array([0.6, 0.4])]
    p, wanted = capped_rake(cells, shares, 0.4 * cells.sum())
    assert p.min() >= 0 and p.max() == 1  # some cells are full
    plain = plain_rake({c: float(cells[c]) for c in np.ndindex(cells.shape)}, wanted)
    for axis, goal in enumerate(wanted):
        others = tuple(a for a in range(3) if a != axis)
        assert np.isclose(goal.sum(), wanted[0].sum())
        expected = (cells * p).sum(axis=others)
        assert np.allclose(expected, goal, rtol=1e-6)
    assert np.allclose(p, [[[plain[i, j, k] for k in range(2)] for j in range(3)] for i in range(3)], atol=1e-4)


def test_categories_that_hold_too_little():
    assert np.allclose(reachable(np.array([100.0, 10, 0, 500]), np.array([0.25, 0.25, 0.25, 0.25]), 300), [100, 10, 0, 190])
    assert np.allclose(reachable(np.array([100.0, 10]), np.array([1.0, 0.0]), 300), [100, 0])
    assert lifted(np.array([10.0, 10, 0]), np.array([2.0, 0.1, 0]), 15) == pytest.approx(5)
    p, wanted = capped_rake(np.array([[5.0, 0], [0, 100]]), [np.array([0.5, 0.5]), np.array([0.9, 0.1])], 60)
    assert np.allclose(wanted, [[5, 55], [5, 55]]) and np.allclose(p, [[1, 0], [0, 0.55]])
    assert not capped_rake(np.zeros((2, 2)), [np.ones(2) / 2] * 2, 10)[0].any()


def test_margins_of_the_registered_targets(spark):
    """Every margin is within a thousandth of its target, or its category is kept whole."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    columns = {"source": F.col("source"), "lang": F.col("lang")}
    found = margins(docs, TARGETS, columns, part=PART).collect()
    assert {r.axis for r in found} == set(TARGETS)
    assert all(abs(r.expected - r.wanted) <= 1e-3 * r.wanted + 1e-9 for r in found)
    total = sum(r.wanted for r in found if r.axis == "lang")
    assert all(r.wanted >= r.share * total - 1e-6 or r.wanted == pytest.approx(r.held) for r in found if r.axis == "lang")
    # held and expected against the rows themselves
    rows = mix(docs, TARGETS, columns, part=PART).toPandas()
    for r in found:
        own = rows[rows[r.axis] == r.category]
        assert own.n_tokens.sum() == r.held and np.isclose((own.n_tokens * own.probability).sum(), r.expected)
    kept = rows[rows.kept]
    for r in found:
        if r.expected > 0.02 * total:
            assert abs(kept[kept[r.axis] == r.category].n_tokens.sum() / r.expected - 1) < 0.15


def test_mix_of_odd_rows(spark, table_of, odd_rows):
    """Clashing names, long texts, nulls and repeated rows; a row's words and topic by plain Python."""
    import re

    schema = "id string, h int, n_tokens string, doc_id long, text string, topic string, probability string, kept int, lang string, source string"
    long = "wort " * 100_000 + "Copyright"
    rows = [("x", 1, "y", i, t, "t", "p", 2, None if k % 2 else "en", "src1") for k, (i, t) in enumerate([*odd_rows, (90, long), (91, "a | b"), (92, "\x0b\x1c a")])]
    df = spark.createDataFrame(rows, schema)
    got = mix(df, TARGETS, {"source": F.col("source"), "lang": F.col("lang")}, part=1.0).collect()
    count = lambda t: len(re.findall(r"[^ \t\n\x0b\f\r]+", t or ""))
    assert sorted(str((r.doc_id, r.n_tokens, r.lang)) for r in got) == sorted(str((r[3], count(r[4]), r[8] or OTHER)) for r in rows)
    assert {r.topic for r in got if r.doc_id in (90, 91)} == {"legal", "table"}
    assert all(r.kept for r in got if r.n_tokens) and len({r.kept for r in got if r.doc_id == 4}) == 1
    assert spark.range(1).select(topic(F.lit(None))).first()[0] == "prose"


def test_mix(spark):
    rows = [(i, f"word{i} " * (1 + i % 7), "en" if i % 3 else "de", f"s{i % 4 % 3}") for i in range(3000)]
    rows += [(None, None, None, None), (3001, "", "en", "s0"), (5, "again this id", "en", "s9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"s0": 0.3, "s1": 0.3, "s2": 0.4}, "lang": {"en": 0.5, "de": 0.5}}
    columns = {"source": F.col("source"), "lang": F.col("lang")}
    found = mix(df, targets, columns).toPandas()
    assert len(found) == len(rows) and found.probability.max() <= 1
    weight = found.n_tokens * found.probability
    for axis, share in targets.items():
        for name, part in share.items():
            assert abs(weight[found[axis] == name].sum() / weight.sum() - part) < 1e-6
            kept = found[found.kept]
            assert abs(kept[kept[axis] == name].n_tokens.sum() / kept.n_tokens.sum() - part) < 0.06
    assert not found.kept[found.source == "(other)"].any()
    half = mix(df, targets, columns, budget=3000).toPandas()
    assert abs((half.n_tokens * half.probability).sum() - 3000) < 1e-3
    assert mix(df.limit(0), targets, columns).count() == 0


def test_nothing_is_left_out_of_a_sample_of_everything(spark):
    df = spark.createDataFrame([(i, "a b c", "en", "s") for i in range(50)], "doc_id long, text string, lang string, source string")
    targets = {"source": {"s": 1.0}, "lang": {"en": 1.0}, "topic": {"prose": None}}
    assert mix(df, targets, {"source": F.col("source"), "lang": F.col("lang")}).where("kept").count() == 50


def test_one_odd_row_does_not_shrink_the_sample(spark):
    """A cell with a single document is kept whole; the others still make up their part of the tokens."""
    import corpus_pipeline as P

    rows = [(i, "word " * 50, ["en", "fr", "de", "es"][i % 4], f"src{i % 20}", 250) for i in range(4000)]
    odd = [(4000, "word " * 50, None, "src0", 250), (4001, "word " * 50, "en", "unknown", 250)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in P.mixed(spark, docs, "").collect()}
    assert abs(len(kept) / len(rows) - PART) < 0.05
    assert {4000, 4001} <= kept
