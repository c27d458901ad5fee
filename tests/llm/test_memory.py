"""What Python workers hold: memory goes back while a task runs, and ids don't depend on the cache."""
import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("helixspan.llm")
from helixspan.llm import common, packing, tokens  # noqa: E402


def test_memory_goes_back_as_batches_pass(monkeypatch):
    calls, seen = [], []
    monkeypatch.setattr(common, "trim_memory", lambda: calls.append(len(seen)))
    monkeypatch.setattr(common, "TRIM_BYTES", 1000)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(100))], ["x"]) for _ in range(10)]  # of 800 bytes

    def run(given):
        for b in given:
            seen.append(b)
            yield b

    assert list(common.released(run)(iter(batches))) == batches
    assert calls == [2, 4, 6, 8, 10, 10]


@pytest.mark.parametrize("words, name", [(False, "byte_bpe_50k.json"), (True, "word_bpe_49k.json")])
def test_ids_do_not_depend_on_the_cache(words, name):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"word{i}, x{i}y" for i in rng.integers(0, 400, 50)) for _ in range(40)] + [None, "", "<|endoftext|> a"]
    path = common.tokenizer_path(name)
    large, small = tokens.encoder(path, words, 1), tokens.encoder(path, words, 1, 20_000)
    assert large is not small and small.cache_bytes == 20_000
    for i in range(0, len(texts), 8):
        for a, b in zip(large.encode(texts[i : i + 8]), small.encode(texts[i : i + 8])):
            assert a.tolist() == b.tolist()
    assert len(small.rows) < len(large.rows)  # it has begun anew


def test_packing_does_not_depend_on_the_cache(spark):
    docs = spark.createDataFrame([(i, f"s{i % 2}", f"text number {i} of some " * (i % 5)) for i in range(40)], "doc_id bigint, source string, text string").repartition(2)
    got, small = (sorted(map(tuple, packing.pack(docs, temperature=0.7, cache_bytes=n).drop("sequence_id", "offset").collect())) for n in (tokens.CACHE_BYTES, 2000))
    assert [r[:5] for r in got] == [r[:5] for r in small]


@pytest.mark.parametrize("words, name", [(False, "byte_bpe_50k.json"), (True, "word_bpe_49k.json")])
def test_marks_behind_a_word_are_no_new_word(words, name):
    from tokenizers import Tokenizer

    path = common.tokenizer_path(name)
    library, enc = Tokenizer.from_file(path), tokens.Encoder(path, words, 1)
    marks = ["***", ".###", "&&&", "%%%", "$", "...", "<=>", "_-_", "'", "'s", "s'.", ".'", '"', "\\^`", "~{|}", "2.", ".2", "!é", "é!", "≠", "́."]
    texts = [f"first {w}{m} then {w}{m}{m}  {m}{w}" for w in ("straw", "Été", "don't", "x1", "漢字", "l") for m in marks]
    ids, sizes = enc.encode(texts)
    for t, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
        assert own.tolist() == [*library.encode(t, add_special_tokens=False).ids, 1], t
    got = enc.rows.keys()
    assert {b"straw", b"***", b".###"} <= got if words else {" straw", "***", ".###"} <= got
