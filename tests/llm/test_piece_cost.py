"""Taking texts apart costs little beside encoding, and odd pieces are encoded as the library does."""

import time

from tokenizers import Tokenizer

from subsetlab.llm import queries
from subsetlab.llm.wordbpe import library_encoder
from subsetlab.llm.words import split_words


def fastest(work):
    took = []
    for _ in range(5):
        begun = time.process_time()
        work()
        took.append(time.process_time() - begun)
    return min(took)


def test_codes_make_no_object_a_value():
    words = split_words([b" ".join(b"w%d" % i for i in range(200_000))])
    values = words.dictionary()[1]
    assert words.codes()[1] == values.to_pylist()
    assert fastest(words.codes) < fastest(words.dictionary) + 0.6 * fastest(values.to_pylist)


def test_odd_pieces():
    texts = ["", " ", "Plain words, and. more!!", "... ?! a1b2 ÀÉÏß×÷.", "one\u0085two three . x\x1cy\x1d", "İstanbul ΑΣ. ΑΣ", "日本語, кот. éa", "A" * 300 + "!."]
    ids, count = library_encoder(queries.vocabulary()).encode([x.encode() for x in texts])
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    want = [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert count.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
