"""Token counts of every prefix, and the longest prefix within a budget, against the library."""

import public_tokenizers
import pytest

from corpusmill.llm import token_counts

BPE = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "unbelievable!internationalisation's zzzzqx", "don't we'll they're 'tis ''re '", "a<|endoftext|>b!<|endoftext|><|endof", "日本語のテキスト、とても長い文字列です。", "naïve cafés İstanbul ΣΑΣ ﬁn",
    "ภาษาไทยไม่มีช่องว่าง", "한국어 한글", "👨‍👩‍👧 ẹ́x 👍🏽12", "  lead\t\ttabs\x1cand\x85odd　space ", "x=1;y<=2//c++::std", "''''ll've", "ab'r c'v",
]


@pytest.fixture(scope="module")
def tools():
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(BPE)
    return lambda t: len(tool.encode(t, add_special_tokens=False).ids), token_counts.counter(BPE)


@pytest.mark.parametrize("text", TEXTS)
def test_every_prefix(tools, text):
    count, own = tools
    for chunk in own.chunks(text):
        assert own.chunk_prefixes(chunk) == [count(chunk[:n]) for n in range(len(chunk) + 1)]
    want = [count(text[:n]) for n in range(len(text) + 1)]
    for budget in range(want[-1] + 2):
        assert own.fits(text, budget) == max(n for n, c in enumerate(want) if c <= budget)


def test_text_without_white_space(tools):
    """A chunk that alone is over the budget is cut inside."""
    count, own = tools
    for text in ("深層学習" * 400, "QUJDREVG" * 500, "a." * 900, "é" * 700):
        cut = own.fits(text, 100)
        assert 0 < cut < len(text) and count(text[:cut]) <= 100 < count(text[: cut + 1])
