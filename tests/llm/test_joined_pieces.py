import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from matchloom.llm.token_planes import Encoder


class Counting:
    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **more):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **more)


def test_new_pieces_go_to_the_library_many_at_once():
    """Ids equal those of whole texts, and the library is called for far fewer texts than there are distinct pieces."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        encoder = Encoder(file.read())
    rng = random.Random(5)
    signs = ["a", "B", "é", "中", "😀", "1", "2", ".", ",", "'s", "!", "<|endoftext|>", " ", " ", "\n", "-", "\t"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(500)]
    texts += [" ".join(f"w{rng.randrange(10**9)}x" for _ in range(50)) for _ in range(40)]
    plain = encoder.tokenizer
    encoder.tokenizer = Counting(plain)
    uneven = 500
    got = encoder.encode(pa.array(texts))
    assert encoder.tokenizer.texts < uneven + 100
    for text, ids in zip(texts, got):
        assert np.array_equal(ids, plain.encode(text, add_special_tokens=False).ids)


def test_pieces_whose_bytes_do_not_add_up_are_encoded_alone():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        encoder = Encoder(file.read())
    pieces = [" one", "two", "\n", "", ".", " drei"]
    alone = encoder.coded(pieces)
    assert encoder.coded_pieces(pieces) == alone
    encoder.widths = encoder.widths + 1
    assert encoder.coded_pieces(pieces) == alone
