"""Operators on single texts against libraries and brute force: piece tokens, token counts, packed ids, quality, languages."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablekit.llm import languages, packed_ids, piece_tokens, quality, token_counts
from tablekit.llm.common import tokenizer_file

ODD = [
    None, "", " ", "  a  b", "\n", "a\n\nb", "a \n b", "x\t \ty", "<s>a</s>", "<|endoftext|>a <|endoftext|>", "aaaaaaaaa" * 50, " " * 40 + "the",
    " " * 31, "▁x ▁", "日本語 テキスト 123  45", "é\U0001F600 　x", "a\r\nb", "\x00a", "don't we'll 'S", "\xa0 a\xa0b", "a\x1cb \x85", "the the" * 300, "x" * 5000,
]


def texts():
    rng = random.Random(5)
    letters = "abcdeé ▁\n thei ouçß.,1 "
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(500)] + [" " * k + "the" for k in range(1, 40)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, i) for i, t in enumerate(texts())] + [(None, "the end", 0), (3, "again", 1), (3, "again", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, N_Tokens long").repartition(3)


def read(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_piece_tokens_are_the_library_s(odd):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))

    def expected(doc_id, text):
        ids = library.encode(text or "", add_eos=True)
        back = library.decode(ids)
        return doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")

    assert read(piece_tokens.encode_decode(odd).collect()) == sorted((expected(r["doc_id"], r["text"]) for r in odd.collect()), key=str)


def test_long_words_take_the_same_table(monkeypatch):
    table = piece_tokens.PrefixTable(tokenizer_file("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    words = ["".join(random.Random(k).choice("theionrsa") for _ in range(70 + k)) for k in range(40)]
    for text, ids in zip(words, table.encode(pa.array(words))):
        assert ids.tolist() == library.encode(text)


def test_token_counts_are_the_library_s(odd):
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))

    def expected(doc_id, text):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        return doc_id, len((text or "").encode()), n, n > 1024

    assert read(token_counts.count_tokens(odd).collect()) == sorted((expected(r["doc_id"], r["text"]) for r in odd.collect()), key=str)


def test_packing_round_trips_at_every_width():
    rng = np.random.default_rng(1)
    for bits in (1, 2, 7, 15, 16, 17, 31, 32):
        for n in (0, 1, 63, 64, 65, 1000):
            ids = rng.integers(0, 2**bits, n).astype("<u4")
            assert (packed_ids.unpack(packed_ids.pack(ids, bits), bits, n) == ids).all()


def test_packed_files_hold_all_ids_in_order(spark, odd, tmp_path, monkeypatch):
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected, start, flat = [], 0, []
    for d, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        flat += ids
    files = packed_ids.write_ids(odd, f"file://{tmp_path}/ids")
    assert read(packed_ids.read_documents(spark, files).collect()) == sorted(expected, key=str)
    # Random access: any range comes from its blocks alone.
    at = 0
    for _, path, _, n in files:
        system, name = packed_ids.open_at(path)
        with system.open_input_file(name) as stream:
            reader = packed_ids.Reader(stream, stream.size())
            for a, b in ((0, 1), (0, n), (n // 3, n // 2), (n, n)):
                assert reader.ids(a, b).tolist() == flat[at + a : at + b]
        at += n


def test_blocks_and_random_access_over_many_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(packed_ids, "BLOCK", 128)
    ids = np.random.default_rng(2).integers(0, 50257, 5000).astype("<u4")
    with open(tmp_path / "x", "wb") as stream:
        writer = packed_ids.Writer(stream, 16)
        for k in range(0, 5000, 37):
            writer.add(k, ids[k : k + 37])
        writer.close()
    system, name = packed_ids.open_at(str(tmp_path / "x"))
    with system.open_input_file(name) as stream:
        reader = packed_ids.Reader(stream, stream.size())
        assert reader.ids(100, 4321).tolist() == ids[100:4321].tolist()
        assert np.concatenate([x for _, _, x in reader.spans(300)]).tolist() == ids.tolist()


def test_quality_on_held_out_labels(spark, data):
    folder = data.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    scored = quality.score_quality(docs, model).join(labels, "doc_id").filter("held_out and quality is not null")
    counts = {(r["quality"], r["predicted"]): r["count"] for r in scored.groupBy("quality", "predicted").count().collect()}
    good = counts[1, 1] / (counts[1, 1] + counts.get((1, 0), 0))
    bad = counts[0, 0] / (counts[0, 0] + counts.get((0, 1), 0))
    assert good > 0.98 and bad > 0.9
    assert quality.accepted(docs, model).count() == quality.score_quality(docs, model).filter("predicted = 1").count()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, "some text here", 1.0) for i in range(6)] + [(None, None, 0.0), (7, "", 0.0)], "doc_id long, text string, Score double")
    empty = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(i, 1) for i in range(6)] + [(None, 0), (2, None)], "doc_id long, quality int")
    both = spark.createDataFrame([(i, i % 2) for i in range(6)] + [(2, 1)], "doc_id long, quality int")
    for labels in (empty, one, both):
        model = quality.fit_quality(docs, labels)
        rows = quality.score_quality(docs, model).collect()
        assert len(rows) == 8 and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["score"] for r in quality.score_quality(docs, quality.fit_quality(docs, empty)).collect()] == [0.5] * 8
    assert {r["score"] for r in quality.score_quality(docs, quality.fit_quality(docs, both)).filter("doc_id is null or doc_id = 7").collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_languages_on_held_out_rows(spark, data):
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/documents.parquet")
    found = languages.identify(docs, languages.fit_languages(docs)).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.filter("lang = lang_pred").count() / found.count() > 0.98


def test_mixtures_and_texts_without_letters(spark, data):
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = languages.fit_languages(docs)
    part = {r["lang"]: r["t"] for r in docs.filter(F.length("text").between(1500, 4000)).groupBy("lang").agg(F.min("text").alias("t")).collect()}
    mixed = [part["en"][:1500] + " " + part["de"][:750], part["fr"][:800]]
    rows = [(1, mixed[0]), (2, mixed[1]), (3, None), (4, ""), (5, "123 !?"), (None, mixed[1]), (2, mixed[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {(r["doc_id"]): r for r in languages.identify(df, model).collect()}
    assert [x["lang"] for x in out[1]["languages"]] == ["en", "de"] and 0.5 < out[1]["score"] < 0.85
    assert out[2]["lang_pred"] == out[None]["lang_pred"] == "fr" and out[2]["score"] == 1
    assert all(out[k]["lang_pred"] == "und" and out[k]["score"] == 0 for k in (3, 4, 5))
    assert languages.identify(df, model).count() == 7
    none = languages.fit_languages(docs.limit(0))
    assert {r["lang_pred"] for r in languages.identify(df, none).collect()} == {"und"}


@pytest.mark.parametrize("work", [piece_tokens.encode_decode, token_counts.count_tokens, packed_ids.packed_round_trip])
def test_empty_tables(spark, work):
    assert work(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_counts_on_every_code_point():
    """Letters and numbers are those of the library's own tables."""
    path = tokenizer_file("byte_bpe_50k.json")
    library, counter = Tokenizer.from_file(path), token_counts.Counter(path)
    for a in (*range(0, 0x33800, 8192), 0xE0000):
        texts = [chr(x) + "贵a" + chr(x) + " " + chr(x) + "1" for x in range(a, a + 8192) if not 0xD800 <= x < 0xE000]
        assert counter.text_counts(pa.array(texts, pa.string())).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("step", [1_024, 4])
def test_long_words(monkeypatch, step):
    """Words of many bytes are those of the libraries, in time about in proportion."""
    monkeypatch.setattr(token_counts, "IN_STEP", step)
    rng = random.Random(8)
    words = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("abcdefghij", "ab", "é🙂x", "A7+/") for n in (5, 300, 5_000, 60_000)]
    path, model = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    library, pieces = Tokenizer.from_file(path), sentencepiece.SentencePieceProcessor(model_file=model)
    assert token_counts.Counter(path).text_counts(pa.array(words)).tolist() == [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    assert [x.tolist() for x in piece_tokens.PrefixTable(model).encode(pa.array(words))] == pieces.encode(words)
