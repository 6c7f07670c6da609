"""Cross-tokenizer alignment against brute force over the libraries."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tablekit.llm import alignment
from tablekit.llm.token_counts import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    spans, counts = [], collections.Counter()
    for _, text in rows:
        text = text or ""
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        wa = [bytes(byte_of[c] for c in first.id_to_token(i)) for i in a]
        wb = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        want = (" " + text).encode()
        if not text or b"".join(wa) != want or b"".join(wb) != want:
            spans.append(None)
            continue
        ends = []
        for words in (wa, wb):
            at, own = 0, []
            for w in words:
                own.append((at, at + len(w)))
                at += len(w)
            ends.append(own)
        links, j = [], 0
        for i, (s, e) in enumerate(ends[0]):
            while ends[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and ends[1][k][0] < e:
                links.append((a[i], b[k]))
                k += 1
        counts.update(links)
        cuts = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(x) for x, (s, e) in zip(ids, own) if low <= s and e <= c) for ids, own in zip((a, b), ends)))
            low = c
        spans.append((a, b, links, groups))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for (d, _), found in zip(rows, spans):
        if found is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups = found
        best = sum(counts[x] == most[x[1]] for x in links)
        out.append((d, len(a), len(b), len(groups), len(links), best, sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(map(str, out))


def texts():
    rng = random.Random(5)
    bits = ["the", "naïve", "Straße", "don't", "ﬁne", "東京", "🙂", "x1y2", "\t", "\n", "\n\n", "  ", " ", " ", " ", "'s", "<|endoftext|>", "</s>", "…", "\r\n", "\x1c", "　", "é", "a" * 60, "1234567", "é", "\x00", "ſ"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 60)))) for i in range(300)]
    rows += [(i, " ".join(rng.choice(["über", "the", "con", "ción", "token", "(x)", "line\nbreak"]) for _ in range(rng.randint(1, 200)))) for i in range(300, 500)]
    rows += [(600, None), (601, ""), (602, " "), (603, "\n"), (604, "a▁b"), (605, "▁"), (606, "\nx y"), (607, " lead"), (None, "null id"), (None, "null id"), (rows[0]), (608, "ab " * 5_000), (609, "z" * 3_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window, piece, pairs, read", [(400_000, 50_000, 4_000_000, 1_000_000), (50, 20, 300, 7)])
def test_cross_alignment(spark, monkeypatch, window, piece, pairs, read):
    for name, value in (("WINDOW", window), ("PIECE", piece), ("BLOCK_PAIRS", pairs), ("READ", read)):
        monkeypatch.setattr(alignment, name, value)
    rows = texts()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, links string, n_best int")
    assert sorted(str(tuple(r)) for r in alignment.cross_alignment(df).collect()) == brute(rows)


def test_cross_alignment_without_rows(spark):
    assert alignment.cross_alignment(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pieces_lose_only_single_spaces():
    text = "ab cd  ef\tgh i j " * 50
    for most in (1, 7, 100):
        assert " ".join(alignment.pieces(text, most)) == text


def test_query_against_brute_force(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = entry.queries()["op12_cross_alignment"](spark, data)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)
