import re

import pytest

VOCABULARY = "word_bpe_49k.json"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = ["", None, "one", "a,b. c  It's DON'T 'S x's, <|endoftext|>. q<|startoftext|>", "é, É! ÀÇ× ΣΑΣ. İstanbul, x.̸ ≠, .́a 12,345.67 “é,” 日本。 🙂,🙂.", " \n\t", "word " * 30_000]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture
def vocabulary():
    return pytest.importorskip("public_tokenizers").path(VOCABULARY)
