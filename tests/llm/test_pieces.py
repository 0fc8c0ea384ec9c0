"""New pieces of letters and signs go to the model itself: same ids, and only where the vocabulary allows it."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, normalizers

from stallkeeper.llm import encode


@pytest.mark.parametrize("name, spaced, fold", [("word_bpe_49k.json", False, str.lower), ("byte_bpe_50k.json", True, str)])
def test_plain_pieces_skip_the_steps_before_the_model(tmp_path, name, spaced, fold):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    draw = random.Random(7)
    texts = [" ".join("".join(draw.choice("aeBÀß÷×éÿZ.,%$'-1\nŒ") for _ in range(draw.randint(1, 9))) for _ in range(40)) for _ in range(60)]
    texts += ["", "Don't stop.", " É́ é É́", "wort.Wort, <|endoftext|>%%% a<|endoftext|>", "ÀÉÎÕÜ àéîõü,", "x  y "]
    made = encode.Encoder(public_tokenizers.path(name), spaced, 4)
    assert made.fold == fold
    whole = [plain.encode(text, add_special_tokens=False).ids for text in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in made.encode(texts)] == whole
    # A vocabulary that strips accents, or that cuts texts at a whole word, is left to the library.
    stripped = Tokenizer.from_file(public_tokenizers.path(name))
    stripped.normalizer = normalizers.Sequence([normalizers.NFD(), normalizers.StripAccents(), normalizers.Lowercase()])
    worded = Tokenizer.from_file(public_tokenizers.path(name))
    worded.add_tokens(["stop"])
    for other in (stripped, worded):
        other.save(f"{tmp_path}/other.json")
        made = encode.Encoder(f"{tmp_path}/other.json", spaced, 4)
        assert made.fold is None
        some = ["Nonstop élan, stop.", "le été"]
        assert [np.frombuffer(x, "<u4").tolist() for x in made.encode(some)] == [other.encode(text, add_special_tokens=False).ids for text in some]
