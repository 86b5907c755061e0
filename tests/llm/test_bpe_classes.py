"""Words are cut as the library cuts them, whatever the character."""

import public_tokenizers
import tiktoken

from eventide.llm import op10_bpe as op10


def test_every_code_point():
    """Ids of every code point between a letter, a number, a space and a line's end are the library's."""
    ranks = op10.default_ranks()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = op10.Encoder(ranks)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{c}1{c} {c}.{c}\n" for c in points[a : a + 20_000]) for a in range(0, len(points), 20_000)]
    for text in texts:
        flat, _ = encoder.encode([text.encode()])
        assert flat.tolist() == library.encode_ordinary(text)


def test_pattern_is_read():
    """Another public pattern gives other words."""
    import re

    assert re.findall(op10.word_pattern(r"\p{L}+|\p{N}|[^\s\p{L}]"), "ab12 Ᲊ!") == ["ab", "1", "2", "Ᲊ", "!"]
