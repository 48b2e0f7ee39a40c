import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from vellumine.llm import token_files as t
from vellumine.llm.common import new_path
from vellumine.llm.tokens import Encoder

TEXTS = [
    "The cat, the hat. It's  12 o'clock\n\nNew line\tand tab ", "", "   ", "\n x", "é à ÀÉ. İstanbul ß ŉ Ǆ", "a\x1cb c\x85d \u3000e", "x <|endoftext|> y <|startoftext|>", "日本語 テキスト e\u0301",
    "word" * 40, "a.b c\n.d e!! f-- --- \n\n g ?", "don't you'll we're I'm 's 't", "- a - b", "µ ª º ² ½ x² ΑΣ.",
]


@pytest.mark.parametrize("name, keeps", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_the_library(spark, name, keeps):
    texts = TEXTS + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    path = public_tokenizers.path(name)
    whole, mine = Tokenizer.from_file(path), Encoder(path, keeps)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode(texts)] == [whole.encode(x, add_special_tokens=False).ids for x in texts]


def test_a_word_is_remembered_once_whatever_its_case_and_punctuation():
    """One entry a word, not one for each of its 60 forms: such memos took most of the memory of op9's workers."""
    path = public_tokenizers.path("word_bpe_49k.json")
    mine, words = Encoder(path, False), [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}ébc" for k in range(500)]
    texts = [" ".join(f"{head}{form}{tail}" for form in (w, w.upper(), w.title()) for head in ("", "(") for tail in ("", ",", ".", ").", ";", ":", "!", "?", '."', ",)")) for w in words]
    tracemalloc.start()
    got = mine.encode(texts)
    del got[:]
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 1e6


def test_latin_texts_are_cut_as_the_library_cuts_them():
    rng = random.Random(3)
    path = public_tokenizers.path("word_bpe_49k.json")
    letters = [chr(k) for k in range(256)] + list("ab's'tdllrevem .,;!?\n\t ABCÀÖÞß²" * 6) + ["<|endoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(5000)] + [chr(a) + chr(b) for a in range(256) for b in range(256)]
    whole = Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(path, False).encode(texts)] == [x.ids for x in whole]


def test_byte_level_texts_are_cut_as_the_library_cuts_them():
    rng = random.Random(4)
    path = public_tokenizers.path("byte_bpe_50k.json")
    letters = [chr(k) for k in range(256)] + list("ab's'tdllrevem .,;!?\n\t  \r\nABCÀÖÞß²7" * 6) + ["<|endoftext|>", "  \n", "'re", "'S"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(5000)]
    texts += [head + chr(a) + chr(b) + "e" for a in range(256) for b in range(256) for head in ("", " ")]
    whole = Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(path, True).encode(texts)] == [x.ids for x in whole]


def test_a_byte_level_word_is_encoded_once_whatever_its_punctuation():
    """It was remembered once for each punctuation and line's start: a third of op5's seconds were for such new chunks."""
    mine = Encoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}ébc" for k in range(500)]
    mine.encode([" ".join(head + w + tail for w in words for head in ("", "(") for tail in ("", ",", ".", ").", ";", ":", "!", "?", '."', ",)"))])
    assert len(mine.memo) + len(mine.words) + len(mine.pieces) < 3 * len(words)


def test_null_ids_are_split_over_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(None, f"text number {k}") for k in range(400)] + [(7, "last")], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little would come to one file
    files = t.write(docs, path, 2, new_path(spark, "tokens"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.filter("n_docs > 1").count() > 1
    got = t.read(spark, files).orderBy("start").collect()
    assert len(got) == 401 and got[-1]["doc_id"] == 7 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))


def test_round_trip_and_selective_reads(spark, monkeypatch):
    monkeypatch.setattr(t, "FRAME_IDS", 20)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(100 - i, x) for i, x in enumerate(TEXTS)] + [(7, None), (7, "seven"), (None, "no id"), (1, "long " * 5000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    files = t.write(docs, path, 2, new_path(spark, "tokens"))
    got = t.read(spark, files).orderBy("start").collect()
    whole = Tokenizer.from_file(path)
    ids_of = lambda x: np.array(whole.encode(x or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
    assert sorted((r["doc_id"] or -1, bytes(r["tokens"])) for r in got) == sorted((d or -1, ids_of(x)) for d, x in rows)
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert order == sorted(order)
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["tokens"]) // 4, zlib.crc32(bytes(r["tokens"])))
        at += r["n_tokens"]
    store, name = fs.FileSystem.from_uri(files.orderBy("part").first()["path"])
    with store.open_input_file(name) as source:
        reader = t.FileReader(source)
        wanted = int(reader.ids[-1])
        seen = []
        whole_frame = reader.frame
        reader.frame = lambda k: seen.append(k) or whole_frame(k)
        assert [d for d, _ in reader.documents([wanted])] == [wanted]
        assert len(seen) == 1
    damaged = bytearray(open(name, "rb").read())
    damaged[12] ^= 1
    with pytest.raises(Exception):
        list(t.FileReader(_Bytes(bytes(damaged))).documents())
    assert t.read(spark, t.write(docs.limit(0), path, 2, new_path(spark, "tokens"))).count() == 0


class _Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]
