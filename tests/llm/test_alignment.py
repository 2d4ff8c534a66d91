import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shelfspark.llm import alignment as op

A, B = f"{op.FOLDER}/byte_bpe_50k.json", f"{op.FOLDER}/piece_bpe_32k.model"
FIELDS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(docs, encoders):
    """docs: (doc_id, text); whole texts, byte by byte."""
    a, b = encoders
    alphabet = op.byte_alphabet()

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    found, counts = [], Counter()
    for doc, text in docs:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a, bytes_b = ([f(i) for i in ids] for f, ids in ((lambda i: bytes(alphabet[c] for c in a.id_to_token(i)), ids_a), (piece, ids_b)))
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            found.append((doc, [], [], [], []))
            continue
        owner_a = [k for k, x in enumerate(bytes_a) for _ in x]
        owner_b = [k for k, x in enumerate(bytes_b) for _ in x]
        links = sorted(set(zip(owner_a, owner_b)))
        pairs = [(ids_a[i], ids_b[j]) for i, j in links]
        counts.update(pairs)
        ends_a, ends_b = (set(np.cumsum([len(x) for x in bs]).tolist()) for bs in (bytes_a, bytes_b))
        groups, i, j, at_a, at_b = [], 0, 0, 0, 0
        for cut in sorted(ends_a & ends_b):
            ga, gb = [], []
            while at_a < cut:
                ga.append(ids_a[i])
                at_a, i = at_a + len(bytes_a[i]), i + 1
            while at_b < cut:
                gb.append(ids_b[j])
                at_b, j = at_b + len(bytes_b[j]), j + 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        found.append((doc, ids_a, ids_b, groups, pairs))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(
        (
            (d, len(x), len(y), len(g), len(p), sum(counts[q] == best[q[1]] for q in p), sum(counts[q] for q in p), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for d, x, y, g, p in found
        ),
        key=repr,
    )


def run(docs):
    return sorted(map(tuple, op.alignment(docs, A, B).select(*FIELDS).collect()), key=repr)


def texts(r, count):
    words = ["the", "tokenization", "of", "Straße", "naïve", "日本語", "слово", "x1", "don't", "<s>", "</s>", "<|endoftext|>", "<0x41>", "🙂", "é", "▁", "▁▁a", "a,b", "3.14", "​", "ﬁ", "Ⅷ", "\x00"]
    joints = [" ", " ", " ", " ", "  ", "\n", " \n ", "\t", "", "   ", " ", "　", "\r\n", "\x1c", " \x1d "]
    return ["".join(r.choice(words) + r.choice(joints) for _ in range(r.randint(1, 60))) for _ in range(count)]


def test_matches_brute_force(docs_of, encoders, monkeypatch):
    r = random.Random(5)
    rows = list(enumerate(texts(r, 150)))
    rows += [(200, None), (201, ""), (202, " "), (203, "\n\n"), (204, "a"), (205, rows[3][1]), (3, rows[3][1]), (None, "the of the"), (206, " the  of"), (207, "of ")]
    want = plain(rows, encoders)
    assert run(docs_of(rows)) == want
    # many runs, several rounds of merging, shared-out radixes
    monkeypatch.setattr(op, "RECORDS", 300)
    monkeypatch.setattr(op, "FAN", 3)
    monkeypatch.setattr(op, "SHARE", 400)
    assert run(docs_of(rows)) == want


def test_empty_table(docs_of):
    assert run(docs_of([])) == []
    assert run(docs_of([(1, None)])) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_very_long_text_and_a_word_in_every_document(docs_of, encoders):
    r = random.Random(6)
    rows = [(0, " ".join(texts(r, 600))), (1, "ab" * 20000)] + [(i, "the same words") for i in range(2, 400)]
    assert run(docs_of(rows)) == plain(rows, encoders)


def test_units_encode_as_whole_texts(encoders):
    a, b = encoders
    both = op.Tokenizers(open(A, "rb").read(), open(B, "rb").read())
    assert both.cuts
    # a text with B's own sign for a space is not given back by its tokens, so it has none
    for text in (t for t in texts(random.Random(7), 2000) if "▁" not in t):
        parts = op.CUT.split(text)
        assert np.concatenate(both.encode_a(parts)).tolist() == a.encode(" " + text, add_special_tokens=False).ids
        assert np.concatenate(both.encode_b(parts)).tolist() == b.encode(text)


def test_both_libraries_divide_every_character_alike(encoders):
    both = op.Tokenizers(open(A, "rb").read(), open(B, "rb").read())
    some = [f"a{chr(c)}b {chr(c)}1{chr(c)}!" for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and c % 7 == 0]
    assert [x.tolist() for x in both.encode_a(some)] == [e.ids for e in encoders[0].encode_batch([" " + t for t in some], add_special_tokens=False)]


def test_runs_merge_in_order():
    r = np.random.default_rng(8)
    runs = [np.unique(r.integers(0, 5000, 700)) for _ in range(9)] + [np.zeros(0, np.int64)]
    total = Counter()
    for keys in runs:
        total.update({k: k % 5 + 1 for k in keys.tolist()})
    op_block, op.BLOCK = op.BLOCK, 64
    try:
        found = [(k, s) for ks, ss in op.merged([op.run_blocks(op.sum_run(k, k % 5 + 1)) for k in runs]) for k, s in zip(ks.tolist(), ss.tolist())]
    finally:
        op.BLOCK = op_block
    assert found == sorted(total.items())


def test_numbers_survive_squeezing():
    values = np.array([0, 1, 255, 256, 2**40, 2**62])
    assert op.opened(op.squeezed(values)).tolist() == values.tolist() and op.opened(op.squeezed(values[:0])).tolist() == []
