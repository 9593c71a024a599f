"""Ids of words: what is kept of texts with lines, which words stay, and ids as the library's."""

import random

import public_tokenizers

from quillstone.llm import token_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["\n", "\n\n", "\r\n", "\t", "\x85", "\xa0", "\x1c", "'s", "'", "a", "Word", "über", "ñ", "3", "½", "...", "$$$", "!?", ")", "—", "<|endoftext|>", "<|", "|>", "日本", "́", "\0", "​", "😀", "ſ"]


def test_lines_end_words():
    made = token_ids.Encoder(PATH)
    made.encode(["To ab.\nCd ef$$$\nGh,\nIj"])
    assert set(made.after) == {"ab", "ab.", "\nCd", "ef", "ef$$$", "\nGh", "\nGh,", "\nIj"}


def test_words_that_came_first_stay(monkeypatch):
    monkeypatch.setattr(token_ids, "KEEP", 100)
    made = token_ids.Encoder(PATH)
    words = [chr(97 + n // 26) + chr(97 + n % 26) for n in range(200)]
    made.encode([" ".join(["x", *words[:40]])])
    made.encode([" ".join(["x", *words])])
    made.encode(["x new"])
    assert set(words[:40]) < set(made.after) and len(made.after) == 51


def test_ids_of_odd_texts_are_the_librarys(monkeypatch):
    monkeypatch.setattr(token_ids, "KEEP", 500)
    made, rng = token_ids.Encoder(PATH), random.Random(5)
    texts = ["".join(rng.choice(PARTS) + rng.choice([" ", "\n", "", ""]) for _ in range(rng.randrange(12))) for _ in range(6000)]
    texts += ["\n", "\na", "a\n", "a\nb", "a\n\nb", "a.\nB, c\nd", "a\n\n<|endoftext|>b", "a\r\nb"]
    assert sum(not token_ids._LOOSE.search(t) for t in texts) > 1000
    assert made.encode(texts) == made._whole(texts)
