"""Caches of the encoders: small generations must give what the library gives."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkclean.llm import common, decontaminate, jaccard, packing, prefix_tokens, quality
from sparkclean.llm.common import Remembered, worker_cache

BITS = ["a", "Word", "word,", "word.", "'s", "don't", " ", "  ", "\t\n", "\xa0", "\x1c", "é", "Éa!", "日本", "12", "...", "x" * 70, " ", "_"]


def texts(n, seed=3):
    pick = random.Random(seed)
    return ["".join(pick.choices(BITS, k=pick.randrange(30))) for _ in range(n)]


def test_generations():
    kept, made = Remembered(20, entry=0), []

    def make(lost):
        made.extend(lost)
        return [k.upper() for k in lost]

    for keys in (["aaaaa"], ["bbbbbbbbbbbbbbbbbbbb"], ["aaaaa"], ["cccccccccccccccccccccc"], ["aaaaa"], []):
        known = kept.fill(keys, make)
        assert all(known[k] == k.upper() for k in keys)
    assert made.count("aaaaa") == 1 and kept.chars < 60


def test_one_object_a_worker():
    first = worker_cache("one", list)
    assert worker_cache("one", list) is first
    worker_cache("two", dict)
    assert worker_cache("one", list) is not first


def test_prefix_steps_with_small_caches():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, counter = Tokenizer.from_file(path), prefix_tokens.PrefixCounter(path)
    counter.units, counter.pieces = Remembered(300), Remembered(300)
    for t in texts(400):
        steps = counter.steps(t)
        assert len(steps) == 2 * len(t)
        assert np.frombuffer(steps, "<i2").sum() == len(library.encode(t, add_special_tokens=False).ids), repr(t)
    for t in texts(15, 5):
        counts = prefix_tokens.prefix_counts(counter.steps(t))
        assert list(counts) == [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)], repr(t)


def test_word_ids_with_small_caches():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    encoder.known, some = Remembered(300), texts(400)
    for start in range(0, 400, 20):
        part = some[start : start + 20]
        for t, ids in zip(part, encoder.encode(part), strict=True):
            assert list(np.frombuffer(ids, "<u4")) == library.encode(t, add_special_tokens=False).ids, repr(t)
    assert list(encoder.encode([])) == []


def test_stable_pairs_without_merging_again(monkeypatch):
    counter = prefix_tokens.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    merged, pick = counter._merged, random.Random(4)
    short = [t for t, body in counter.text.items() if len(body) < 4]
    pairs = [(pick.choice(short), pick.choice(short)) for _ in range(4000)] + [(-1, t) for t in counter.text]
    want = {p: merged([counter.token[bytes([c])] for t in p if t >= 0 for c in counter.text[t]]) == [t for t in p if t >= 0] for p in pairs}
    monkeypatch.setattr(counter, "_merged", None)
    assert {p: counter._fits(*p) for p in pairs} == want and counter.ordered


def test_pairs_of_an_unordered_vocabulary():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, counter = Tokenizer.from_file(path), prefix_tokens.PrefixCounter(path)
    counter.ordered = False
    for t in texts(40, 8):
        assert np.frombuffer(counter.steps(t), "<i2").sum() == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_spellings_of_a_word_share_their_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    words = [w + tail for w in ("éviré", "Éviré", "inhaed", "INHAED", "x1.y2@z.com") for tail in ("", ".", "###", "$$$", "&&&.", "'s.", "'.", '."', "</")]
    more = ["<|endoftext|>.", "a<|ENDOFTEXT|>b.", "don't.", "İ.İ", "ΑΣ. Σ", "ß.ẞ.", "e\u0301.e", "a.\u0301", "=\u0338 a=\u0338", "×.÷.", "1²." + "q" * 80 + "."]
    for t, ids in zip([" ".join(words), *words, *more], encoder.encode([" ".join(words), *words, *more]), strict=True):
        assert list(np.frombuffer(ids, "<u4")) == library.encode(t, add_special_tokens=False).ids, repr(t)
    encoder.known = Remembered(10_000)
    list(encoder.encode([" ".join(words)]))
    assert len(encoder.known.new) < len(words)


def test_memory_is_given_back_after_a_task_and_with_the_object(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    assert list(common.giving_back(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and given == [1]
    worker_cache("three", list)
    worker_cache("three", list)
    assert given == [1, 1]
    monkeypatch.undo()
    common.give_back()


@pytest.mark.parametrize("module", [quality, jaccard, decontaminate, packing])
def test_workers_of_the_pipeline_take_texts_in_small_batches(spark, monkeypatch, module):
    df = spark.range(0, 800, 1, 1).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), 2000) as text")
    sizes = []

    def size(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    class Ran(Exception):
        pass

    def measured(frame=None, label=None):
        got = df.mapInArrow(size, "n bigint, bytes bigint").collect()
        sizes.append((max(r["n"] for r in got), max(r["bytes"] for r in got)))
        raise Ran

    if module is packing:  # the batches of the job that writes the pieces
        monkeypatch.setattr(packing, "stored", measured)
        run = lambda: packing.pack(packing.pieces(df, public_tokenizers.path("word_bpe_49k.json")))
    elif module is jaccard:
        monkeypatch.setattr(jaccard, "stored", measured)
        run = lambda: jaccard.classes(df)
    elif module is quality:
        run = lambda: (quality.features(df, quality.QualityModel(b"a", b"b"), "text", ["doc_id"]), measured())
    else:
        items = decontaminate.Items(["x"], [np.arange(9, dtype=np.uint64)], 4, 0.6)
        run = lambda: (decontaminate.with_matches(df, items), measured())
    with pytest.raises(Ran):
        run()
    assert sizes[0][0] <= 500 and sizes[0][1] < 3_000_000
