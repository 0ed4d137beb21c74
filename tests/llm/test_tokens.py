import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from furrow.llm.packing import fullest, pack, plan, sequences
from furrow.llm.token_files import read_token_files, vocabulary_path, write_token_files
from furrow.llm.tokens import Encoder
from furrow.session import new_folder

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PIECES = [" ", "  ", "\n", "\t", "\r\n", "a", "Wort", "straße", "ÉTÉ", "é", "́", "it's", "'s", "'", ".", ",", "...", "1234", "日本", " ", " ", "ΑΣ",
          "x\u001cy", "<|endoftext|>", "😀", "$%&", "ª", "ǅ", "\u0000"]


def ids_of(name, text):
    return Encoder.of(vocabulary_path(name)).tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=6))
def test_ids_are_those_of_the_whole_text(name, texts):
    ids, offsets = Encoder.of(vocabulary_path(name)).encode(pa.array([*texts, None]))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [ids_of(name, t) for t in [*texts, None]]


def test_forgetting_changes_nothing(monkeypatch):
    from furrow.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    encoder = Encoder(vocabulary_path(NAMES[0]))
    for k in range(5):
        texts = [" ".join(f"word{chr(97 + j)}{chr(97 + k)} other" for j in range(20)), "one more."]
        ids, offsets = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [ids_of(NAMES[0], t) for t in texts]


@pytest.mark.parametrize("name", NAMES)
def test_words_side_by_side(name):
    """Words part at their first or last tokens; the library's slower call, which notes every place, is not needed."""
    encoder = Encoder(vocabulary_path(name))
    words = [" " + w for w in ("Wort", "straße", "ÉTÉ", "été", "a", "I", "Ærøskøbing", "don", "ÿÿÿ", "xqzwvkj" * 9)]
    plain = encoder.tokenizer
    want = [plain.encode(w, add_special_tokens=False).ids for w in words]

    class Fast:
        encode_batch_fast = plain.encode_batch_fast

    encoder.tokenizer = Fast()
    ids, count = encoder._side_by_side(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == want
    # without marks in the vocabulary, the places tell the same
    encoder.tokenizer = plain
    encoder.first[:] = encoder.last[:] = False
    ids, count = encoder._side_by_side(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == want


@pytest.mark.parametrize("name", NAMES)
def test_marks_after_a_word_make_no_other_word(name):
    encoder = Encoder(vocabulary_path(name))
    texts = ["x " + " ".join("wort" + m for m in ("", ",", "$$$", ",%%%", "!!", "...", '"', "|~", "()[]", "'", "'s", "-a"))]
    ids, _ = encoder.encode(pa.array(texts))
    assert ids.tolist() == ids_of(name, texts[0])
    assert sum(w.startswith(" wort") for w in encoder.words.strings.to_pylist()) == 4  # the plain one, two apostrophes, one hyphen


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, table_of, odd_rows):
    manifest = write_token_files(table_of(odd_rows), new_folder(spark), vocabulary_path(NAMES[0]), 2)
    got = sorted(read_token_files(manifest).collect(), key=lambda r: r.start)
    want = sorted(((i is not None, i or 0), i, [*ids_of(NAMES[0], t), 2]) for i, t in odd_rows)
    assert [r.doc_id for r in got] == [i for _, i, _ in want]
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == collections.Counter((i, len(x), crc(x)) for _, i, x in want)
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])))[:-1].tolist()


def test_empty_token_files(spark, table_of):
    assert read_token_files(write_token_files(table_of([]), new_folder(spark), vocabulary_path(NAMES[0]), 2)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=12), st.integers(0, 30))
def test_fullest_is_the_fullest(lengths, space):
    reach = {0}
    for n in lengths:
        reach |= {r + n for r in reach if r + n <= space}
    chosen = fullest(np.bincount(lengths, minlength=space + 13), space)
    assert sum(chosen) == max(reach)
    assert not collections.Counter(chosen) - collections.Counter(lengths)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_plan_places_every_piece_once(lengths):
    table, n = plan(np.bincount(lengths, minlength=17), 16)
    filled = collections.defaultdict(list)
    numbers = collections.Counter()
    for length, first, end, sequence, offset in table.tolist():
        assert first == numbers[length]
        numbers[length] = end
        for k in range(end - first):
            filled[sequence + k].append((offset, length))
    assert numbers == collections.Counter(lengths) and sorted(filled) == list(range(n))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 16


@pytest.mark.parametrize("size", [64, 2048])
def test_pack(table_of, odd_rows, size):
    packed = pack(table_of(odd_rows), vocabulary_path(NAMES[1]), 0, size=size)
    got = packed.collect()
    want, total = collections.Counter(), 0
    for i, t in odd_rows:
        ids = [*ids_of(NAMES[1], t), 0]
        total += len(ids)
        want.update((i, p // size, p, len(ids[p : p + size]), crc(ids[p : p + size])) for p in range(0, len(ids), size))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    filled = collections.defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    for parts in filled.values():
        ends = np.cumsum([n for _, n, _ in sorted(parts)])
        assert [o for o, _, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= size
    assert len(filled) <= math.ceil(total / size) + 1
    joined = {r.sequence_id: bytes(r.ids) for r in sequences(packed).collect()}
    assert joined == {s: b"".join(x for _, _, x in sorted(parts)) for s, parts in filled.items()}


def test_pack_empty(table_of):
    assert pack(table_of([]), vocabulary_path(NAMES[1]), 0).count() == 0
