"""Words and the signs behind them are learned apart, with the tokenizer's own ids."""

import itertools
import random

import public_tokenizers

from docloom.llm import packing


def test_letters_with_other_signs_are_one_word():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäéñß") for _ in range(rng.randrange(2, 24))) for _ in range(1000)]
    signs = ["", ",", ".", "!!", "***", "$%&"]
    texts = [" ".join(w + s for w in words) for s in signs]
    texts += [" ".join(a + s + b for a, b in itertools.pairwise(words[:50])) for s in ("'s", "'", "' ", "-", "—!!", "́.", "  ,", "7,", "'ll?", "<", "|>", "ª.", "𝒳!")]
    texts += ["", " ", "...", "it's, don't! we'll' 's, 'd. x²? Ünder.,; ΑΣ. ﬁn! ①. _a_ a_. क्षि. ไทย!", "a" * 90 + "!!", "é" * 40 + "."]
    w = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for text, ids in zip(texts, w.encode(texts), strict=True):
        assert ids.tolist() == w.tok.encode(text, add_special_tokens=False).ids, text[:80]
    w._clear()
    w.encode(texts[: len(signs)])
    assert len(w.place) <= len(words) + len(signs)
