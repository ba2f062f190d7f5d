import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from orrery.llm import alignment
from orrery.llm.alignment import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def awkward():
    rng = random.Random(3)
    letters = lambda n, alphabet="abcdefé ": "".join(rng.choices(alphabet, k=n))
    texts = [
        None, "", " ", "  ", "a", "Hello world", " lead", "two  spaces", "tab\there\n\nlines", "<|endoftext|> and <s> </s> <unk> <0x41>", "naïve café", "日本語のテキスト", "emoji 🙂🙃 zwj 👩‍👩‍👧", "▁ piece", "a▁b",
        "\x00nul", "ﬁ ligature Å Å", "1234567890 3.14159", "don't we'll", letters(500), letters(3000, "abc \n"), "x" * 5000, letters(4000, "αβγ дёж "), "word " * 300, " nbsp em", "\r\n\r\n",
        "the same text", "the same text", "one\n two", "one \ntwo", "one\ntwo three\n", "tab\t tab", "a b ", "x" * 65 + " y", "don't 's 't x's", "1 23 a1 1a ,a a, . .", "\x1c a\x1cb \x1f", "à la  x", letters(250_000, "etaoin shrdlu "),
    ]
    return [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (7, "repeated"), (7, "repeated")]


def brute(rows):
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = alignment._byte_of_letter()
    found, pairs = [], Counter()
    for key, text in rows:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            found.append((key, 0, 0, [], []))
            continue
        groups, links, i, j, end_a, end_b, from_a, from_b = [], [], 0, 0, 0, 0, 0, 0
        while i < len(ids_a) or j < len(ids_b):
            if end_a <= end_b:
                end_a, i = end_a + len(bytes_a[i]), i + 1
            else:
                end_b, j = end_b + len(bytes_b[j]), j + 1
            if end_a == end_b:
                groups.append(",".join(map(str, ids_a[from_a:i])) + "|" + ",".join(map(str, ids_b[from_b:j])))
                links.append((ids_a[i - 1], ids_b[j - 1]))
                from_a, from_b = i, j
        pairs.update(links)
        found.append((key, len(ids_a), len(ids_b), groups, links))
    most = Counter()
    for (_, second), n in pairs.items():
        most[second] = max(most[second], n)
    out = []
    for key, n_a, n_b, groups, links in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((key, n_a, n_b, len(groups), len(links), digest, sum(pairs[x] == most[x[1]] for x in links), sum(pairs[x] for x in links)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, b"l", 1) for k, t in awkward()], "doc_id long, text string, links binary, n_a long").repartition(3)


def run(docs):
    return alignment.align_documents(docs, lambda: alignment.byte_level(A), lambda: alignment.pieces(B))


def test_against_brute_force(docs, monkeypatch):
    got = run(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(awkward()), key=str)


def test_empty_table(docs):
    assert run(docs.limit(0)).count() == 0
    assert run(docs.where("text IS NULL")).collect()[0]["groups_sha256"] == ""


def plain(cut):
    """A tokenizer of single letters, or of runs that end with a letter of ``cut``."""
    entries = [bytes([c]) for c in range(256)] + [bytes([c, d]) for c in b" abc" for d in b"abc"]
    ids = {e: k for k, e in enumerate(entries)}

    def encode(texts):
        out = []
        for text in texts:
            raw, k, found = b" " + text.encode(), 0, []
            while k < len(raw):
                step = 2 if raw[k : k + 2] in ids and raw[k + 1 : k + 2] in cut else 1
                found.append(ids[raw[k : k + step]])
                k += step
            out.append(np.array(found, dtype=np.int64))
        return out

    return Tokenizer(encode, entries)


def test_random_slices_against_a_walk():
    rng = random.Random(9)
    a, b = plain(b"a"), plain(b"bc")
    for _ in range(60):
        texts = ["".join(rng.choices("abcd", k=rng.randrange(9))) for _ in range(rng.randrange(6))]
        counts, groups, link_a, link_b = alignment.align(texts, alignment.ByWords(a, b))
        at = 0
        for k, text in enumerate(texts):
            ends = [np.cumsum(t.lengths[t.encode([text])[0]]).tolist() if text else [] for t in (a, b)]
            both = [x for x in ends[0] if x in ends[1]]
            assert (counts["n_a"][k], counts["n_b"][k], counts["n_groups"][k]) == (len(ends[0]), len(ends[1]), len(both))
            assert groups[k].count(b";") == max(0, len(both) - 1)
            ids = [t.encode([text])[0] for t in (a, b)]
            want = [(int(ids[0][ends[0].index(x)]), int(ids[1][ends[1].index(x)])) for x in both]
            assert list(zip(link_a[at : at + len(both)].tolist(), link_b[at : at + len(both)].tolist(), strict=True)) == want
            at += len(both)


def test_links_are_tails():
    """The bound of the broadcast: of two linked tokens the shorter is a tail of the longer."""
    a, b = alignment.byte_level(A), alignment.pieces(B)
    texts = [t for _, t in awkward() if t]
    _, _, link_a, link_b = alignment.align(texts, alignment.ByWords(a, b))
    for x, y in set(zip(link_a.tolist(), link_b.tolist(), strict=True)):
        assert a.entries[x].endswith(b.entries[y]) or b.entries[y].endswith(a.entries[x])
    assert sum(map(len, a.entries)) + sum(map(len, b.entries)) < 700_000


def test_counts_are_given_out_in_parts(docs, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 64)
    monkeypatch.setattr(alignment, "HELD_LINKS", 8)
    test_against_brute_force(docs, monkeypatch)


def test_words_encode_as_in_their_texts(monkeypatch):
    monkeypatch.setattr(alignment, "GROUP", 3)
    monkeypatch.setattr(alignment.ByWords, "HELD", 40)
    a, b = alignment.byte_level(A), alignment.pieces(B)
    pair = alignment.ByWords(a, b)
    rng = random.Random(1)
    texts = [t for _, t in awkward() if t and len(t) < 9000] + ["".join(rng.choices("ab c\n\t1'sé.,! \xa0\u3000日<|>▁", k=rng.randrange(1, 40))) for _ in range(600)]
    for at in range(0, len(texts), 20):
        part = texts[at : at + 20]
        for text, *found in zip(part, *pair.encode(part), strict=True):
            whole = [t.encode([text])[0] for t in (a, b)]
            kept = all(t.gives_back(text, ids) for t, ids in zip((a, b), whole, strict=True))
            assert [x.tolist() for x in found] == [x.tolist() if kept else [] for x in whole]
