"""Words encoded apart give the ids of whole texts; most need no marks between them."""

import random

from docmill.llm import packing

PARTS = ["a", "B", "é", "É", "'", "s", "'s", "'T", ".", ",", "~", "<|endoftext|>", "<|ENDOFTEXT|>", "<", "|", ">", "1", "9", "ß", "́", "̱", "H"]
PARTS += [" ", "​", "İ", "K", "Σ", "中", "-", "_", "%", "Word", "²", " ", "\x1c", "\x85", "😀", "</w>", "w", "/"]


def test_odd_words_against_whole_texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 7)))
    texts = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(2000)]
    encode = packing.WordEncoder(packing.public_tokenizer(), cached_words=5000)
    assert encode.by_word and encode.has_ends
    assert [x for k in range(0, 2000, 300) for x in encode(texts[k : k + 300])] == encode._ids(texts)


def test_letters_and_their_punctuation_need_no_marks(monkeypatch):
    marked, words = [], packing.WordEncoder._words
    monkeypatch.setattr(packing.WordEncoder, "_words", lambda self, own: marked.extend(own) or words(self, own))
    encode = packing.WordEncoder(packing.public_tokenizer())
    text = "Über letters, they said... don't count 12 or a1 (really)!"
    assert encode([text]) == encode._ids([text])
    assert sorted(marked) == [b"(really)!", b"12", b"a1", b"don't"]
