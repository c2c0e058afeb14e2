"""The word-wise encoder gives what the whole tokenizer gives."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import tokens


def whole(text):
    return tokens.encoder(tokens.default_path()).whole.encode(text, add_special_tokens=False).ids


def mine(text):
    return np.frombuffer(tokens.encoder(tokens.default_path()).encode(text), "<u2").tolist()


def test_plain_and_odd_texts():
    for text in ("", " ", "Hello, World's 123 a1b2", "ÉTÉ çа va ß ΑΣ Σ", "a<|endoftext|>b <|x", "x\x0by\x1cz w　v", "İ i̇ é ́e", "你好 世界", "it's we'LL 'S", "x" * 3000, "\x01\x02", "ﬁ ½ ǅ"):
        assert mine(text) == whole(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aAbZ ',.!19\n\t\r\x0b éÉßΣσİ́<|你'stll"), max_size=40))
def test_any_text(text):
    assert mine(text) == whole(text)


def test_small_tables_give_the_same():
    e = tokens.Encoder(tokens.default_path(), words=3)
    for text in ("one two three four five, six!", "one two seven"):
        assert np.frombuffer(e.encode(text), "<u2").tolist() == whole(text)


def test_one_encoder_of_the_size_asked_for():
    path = tokens.default_path()
    large = tokens.encoder(path, 800_000)
    assert large.most == 400_000 and tokens.encoder(path, 800_000) is large
    assert tokens.encoder(path).most == 200_000 and len(tokens._ENCODERS) == 1
